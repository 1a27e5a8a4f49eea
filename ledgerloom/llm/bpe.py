"""Byte-level BPE as a monoid: encode halves, join neighbours, re-encode only around the seam.

A token sequence is the encoding of its bytes exactly if every two neighbouring tokens are: if encoding the bytes of
the pair gives back the pair. So when two encodings are joined, a window of the last tokens of the left and the first of
the right one is encoded anew and grows until both of its edges are stable against the tokens outside; what is outside
then cannot change. The join is associative, so a long piece is a balanced tree of short ones, and a text is the
concatenation of its pieces (the matches of the splitting pattern), in order.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import per_row, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes up to which a piece is merged directly; pieces up to KEEP bytes are remembered, CACHE of them at most.
LEAF, KEEP, CACHE = 24, 48, 250_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder(dict):
    """Piece (text) to packed ids (little-endian unsigned 32 bits); as a dict, it remembers short pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        lines = Path(path).read_bytes().split(b"\n")
        self.ranks = {base64.b64decode(a): int(b) for a, _, b in (x.partition(b" ") for x in lines) if a}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pieces = regex.compile(pattern).findall
        self.stable = lru_cache(1 << 16)(self._stable)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        ids = (rank,) if rank is not None else self.merge(raw) if len(raw) <= LEAF else self.tree(raw)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= KEEP:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = packed
        return packed

    def merge(self, raw: bytes) -> list[int]:
        """Direct merging: the lowest rank first, the leftmost of equals."""
        parts, ranks, none = [raw[i : i + 1] for i in range(len(raw))], self.ranks, 1 << 32
        costs = [ranks.get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while costs and (best := min(costs)) != none:
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1], none)
        return [ranks[p] for p in parts]

    def _stable(self, left: int, right: int) -> bool:
        return self.merge(self.tokens[left] + self.tokens[right]) == [left, right]

    def tree(self, raw: bytes) -> list[int]:
        """A balanced reduction, level by level, so that no piece is too long for the stack."""
        level = [self.merge(raw[i : i + LEAF]) for i in range(0, len(raw), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = left[len(left) - i :] + right[:j]
            seam = b"".join(map(self.tokens.__getitem__, window))
            # A window is shorter than what it joins, or it is all of it: then nothing is left to reuse.
            mid = self.merge(seam) if len(seam) <= 4 * LEAF or (i == len(left) and j == len(right)) else self.tree(seam)
            good_left = i == len(left) or self.stable(left[-i - 1], mid[0])
            good_right = j == len(right) or self.stable(mid[-1], right[j])
            if good_left and good_right:
                return left[: len(left) - i] + mid + right[j:]
            i, j = i if good_left else 2 * i, j if good_right else 2 * j

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, packed: bytes) -> bytes:
        """Concatenates up the tree: runs of tokens first, then the runs."""
        ids = np.frombuffer(packed, "<u4")
        return b"".join(b"".join(map(self.tokens.__getitem__, ids[i : i + 65536].tolist())) for i in range(0, len(ids), 65536))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    return _ENCODERS.get((path, pattern)) or _ENCODERS.setdefault((path, pattern), Encoder(path, pattern))


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, n_tokens, ids (array of int), ids_sha256, decoded_sha256: one row per input row.

    Whole texts, no special tokens; a null text counts as empty and has no tokens. Repeated rows stay; other columns
    are ignored, and an empty df gives no rows. `path` is a file of ranks that every executor can open (part of the
    installed tokenizer package by default).
    """
    path, pattern = path or vocabulary_path(), pattern or split_pattern()

    def make():
        e, sha = encoder(path, pattern), hashlib.sha256

        def work(texts: list) -> list[list]:
            packed = [e.encode(t or "") for t in texts]
            ids = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
            return [[len(p) // 4 for p in packed], ids, [sha(p).hexdigest() for p in packed], [sha(e.decode(p)).hexdigest() for p in packed]]

        return work

    return per_row(df, [id_col], text_col, {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}, make)


def bpe_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_encode without the ids themselves, for the same rows."""
    path, pattern = vocabulary_path(), split_pattern()

    def make():
        e, sha = encoder(path, pattern), hashlib.sha256

        def work(texts: list) -> list[list]:
            packed = [e.encode(t or "") for t in texts]
            return [[len(p) // 4 for p in packed], [sha(p).hexdigest() for p in packed], [sha(e.decode(p)).hexdigest() for p in packed]]

        return work

    return per_row(df, [id_col], text_col, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, make)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op6_bpe": op6_bpe}
