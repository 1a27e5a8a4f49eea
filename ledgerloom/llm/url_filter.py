"""URL filters over a sorted digest array.

The rules are kept as one file: a sorted array of 64-bit xxhash keys, the verdicts, and the full strings. Spark ships
the file to each executor (`addFile`), workers map it into memory, look up every candidate of a slice by one vectorised
binary search, and compare the stored string, so that a colliding key never decides. A rule is `host` plus path prefix;
candidates are the parent domains with as many labels as some rule has, each with the path prefixes whose lengths occur
in the rules, so an address of many labels costs no more than one of few.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import FOLD, per_row, table

#: (verdict, host, path); fixed values of the query's contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    return host.encode().translate(FOLD).decode(), rest[: min(ends)] if ends else rest


class DigestIndex:
    """Layout: count; then for each rule, in order of key, the key; then its verdict, labels and path length in one
    number, and where its string begins and ends; then the strings.

    Equal keys stand side by side, one entry for each string.
    """

    def __init__(self, path: str) -> None:
        n = int(np.fromfile(path, dtype="<u8", count=1)[0])
        self.keys = np.memmap(path, dtype="<u8", mode="r", offset=8, shape=(n,)) if n else np.empty(0, "<u8")
        self.meta = np.memmap(path, dtype="<u8", mode="r", offset=8 + 8 * n, shape=(n, 3)) if n else np.empty((0, 3), "<u8")
        self.text = np.memmap(path, dtype=np.uint8, mode="r", offset=8 + 32 * n) if n else np.empty(0, np.uint8)
        meta = np.asarray(self.meta[:, 0])
        self.path_lengths = np.unique(meta >> np.uint64(32)).tolist()
        self.labels = np.unique(meta >> np.uint64(1) & np.uint64((1 << 31) - 1)).tolist()

    @staticmethod
    def write(path: str, rules: Iterable[tuple[str, str, str]]) -> None:
        unique = {f"{host}\0{p}".encode(): len(p) << 32 | (host.count(".") + 1) << 1 | (verdict == "allow") for verdict, host, p in rules}
        found = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in unique.items())
        ends = np.cumsum([0, *(len(k) for _, k, _ in found)])
        with open(path, "wb") as f:
            f.write(np.array([len(found)], "<u8").tobytes())
            f.write(np.array([h for h, _, _ in found], "<u8").tobytes())
            f.write(np.array([(v, a, b) for (_, _, v), a, b in zip(found, ends[:-1], ends[1:], strict=True)], "<u8").tobytes())
            f.write(b"".join(k for _, k, _ in found))

    def lookup(self, probes: list[bytes]) -> list[int]:
        """-1, or the entry of each probe."""
        keys = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), dtype=np.uint64, count=len(probes))
        left = np.searchsorted(self.keys, keys, "left")
        out = np.full(len(probes), -1, dtype=np.int64)
        if len(self.keys):
            for i in np.nonzero(self.keys[np.minimum(left, len(self.keys) - 1)] == keys)[0]:
                at = int(left[i])
                while at < len(self.keys) and self.keys[at] == keys[i]:
                    _, a, b = self.meta[at]
                    if self.text[int(a) : int(b)].tobytes() == probes[i]:
                        out[i] = at
                        break
                    at += 1
        return out.tolist()

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str | None]]:
        """(host, path, rule, verdict) of each url; rule and verdict null where none fits.

        The longest rule (host and path together) wins; of equally long ones that of the longer host.
        """
        parts, probes, owner = [split_url(u) for u in urls], [], []
        for i, (host, path) in enumerate(parts):
            for k in self.labels if host else ():
                more = host.count(".") + 1 - k
                if more < 0:
                    continue
                domain = host[len(host.rsplit(".", k)[0]) + 1 :] if more else host
                for n in self.path_lengths:
                    if n <= len(path):
                        probes.append(f"{domain}\0{path[:n]}".encode())
                        owner.append(i)
        best: dict[int, tuple[int, int, str, str]] = {}
        for i, p, at in zip(owner, probes, self.lookup(probes), strict=True):
            if at >= 0:
                host, _, path = p.decode().partition("\0")
                best[i] = max(best.get(i, (-1, -1, "", "")), (len(host) + len(path), len(host), f"{host}{path}", "allow" if int(self.meta[at][0]) & 1 else "block"))
        return [(*parts[i], *(best[i][2:] if i in best else (None, None))) for i in range(len(parts))]


_OPEN: dict[str, DigestIndex] = {}


def ship(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Writes the index and hands it to all executors; returns its name, which its content determines.

    The file lies in the driver's own folder of shipped files, which Spark serves to executors and deletes at the end.
    """
    folder = os.path.join(SparkFiles.getRootDirectory(), "url-rules")
    os.makedirs(folder, exist_ok=True)
    DigestIndex.write(raw := os.path.join(folder, f"raw-{os.getpid()}"), rules)
    name = f"url-rules-{hashlib.sha256(Path(raw).read_bytes()).hexdigest()[:32]}"
    if os.path.exists(os.path.join(folder, name)):
        os.remove(raw)
    else:
        os.rename(raw, os.path.join(folder, name))
        spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def url_filter(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict: one row per input row, repeated ones too.

    The longest fitting rule decides, else `default`: an address that is in no list passes. Null urls and urls without
    `://` have empty host and path and fit no rule. Other columns are ignored; an empty df gives no rows.
    """
    name = ship(df.sparkSession, rules)

    def make():
        index = _OPEN.get(name) or _OPEN.setdefault(name, DigestIndex(SparkFiles.get(name)))

        def work(urls: list) -> list[list]:
            host, path, rule, verdict = zip(*index.judge(urls), strict=True) if urls else ((), (), (), ())
            return [host, path, rule, [v or default for v in verdict]]

        return work

    return per_row(df, [id_col], url_col, {"host": "string", "path": "string", "rule": "string", "verdict": "string"}, make)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


SQL = {
    "op5_url_filter": r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM p),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
}
QUERIES = {"op5_url_filter": op5_url_filter}
