"""WARC as a chunked record table.

An archive is a byte stream kept as rows of at most some 256 KB: blocks of whole small records, and for each record with
an oversized payload one row a chunk, with the record's identifier and the chunk's number. Concatenated by block number
the rows are the WARC file. Oversized payloads are cut into chunks before they reach a Python worker, and read back chunk
by chunk through an incremental digest, so that no worker holds such a record as a whole. An index tells how many rows
each archive has; a reader refuses archives whose rows are not all there.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_heavy, scratch, small_batches, table

#: Payload bytes of a chunk, bytes of a block of whole records, least payload that is worth a revisit.
CHUNK, BLOCK, LEAST = 16_384, 262_144, 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Duplicate digests up to which they are broadcast (some 60 bytes each); beyond it pages are joined by shuffle.
BROADCAST_DIGESTS = 50_000
END = b"\r\n\r\n"
TABLE = "archive string, block bigint, record string, chunk int, data binary"


class Damaged(ValueError):
    """Rows of an archive are missing or altered."""


def head(name: str, url: str | None, kind: str, digest: str, size: int, refers_to: int | None) -> bytes:
    """The header of a record; a revisit has no block of its own and names the payload's length instead."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", str(size))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(0 if kind == "revisit" else size))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def fields_of(header: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in header.decode().split("\r\n")[1:] if x)


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
    return int(text) if text else None


def _result(f: dict[str, str], size: int, digest: str) -> tuple:
    if f["WARC-Type"] == "revisit":
        size, digest = int(f["X-Payload-Length"]), base64.b32decode(f["WARC-Payload-Digest"][5:]).hex()
    elif digest != base64.b32decode(f["WARC-Payload-Digest"][5:]).hex():
        raise Damaged(f"damaged payload of {f['WARC-Record-ID']}")
    return _page(f["WARC-Record-ID"]), size, digest, f["WARC-Type"], _page(f.get("WARC-Refers-To"))


def pack(parts: Iterable[tuple], archive: str, block: int = BLOCK) -> Iterator[tuple]:
    """Rows of TABLE from (page_id, url, digest, size, refers_to, revisit, again, part, parts, data), in order.

    A record of one part is packed into a block with others; the parts of a longer one are rows of their own. `again`
    marks an id that several rows have: their record identifiers are told apart by archive and number.
    """
    number, held, length, n = 0, [], 0, -1
    for page_id, url, digest, size, refers_to, revisit, again, part, count, data in parts:
        header = b""
        if part == 0:
            n += 1
            name = "" if page_id is None else str(page_id)
            header = head(f"{name}:{archive}:{n}" if again else name, url, "revisit" if revisit else "response", digest, size, refers_to)
        if held and (count > 1 or length + len(header) + len(data) > block):
            yield archive, number, None, None, b"".join(held)
            number, held, length = number + 1, [], 0
        if count > 1:
            yield archive, number, f"{archive}/{n}", part, header + data + (END if part == count - 1 else b"")
            number += 1
        else:
            held += [header, data, END]
            length += len(header) + len(data) + len(END)
    if held:
        yield archive, number, None, None, b"".join(held)


def parse(block: bytes) -> Iterator[tuple]:
    """Results of a block of whole records."""
    at = 0
    while at < len(block):
        body = block.index(END, at) + len(END)
        f = fields_of(block[at:body])
        size = int(f["Content-Length"])
        if block[body + size : body + size + len(END)] != END:
            raise Damaged(f"{f['WARC-Record-ID']} is cut off")
        yield _result(f, size, hashlib.sha1(block[body : body + size]).hexdigest())
        at = body + size + len(END)


def follow(chunks: Iterable[tuple[str, int, bytes]]) -> Iterator[tuple]:
    """Results of oversized records from (record, chunk, data) in order; only digest, counts and one chunk are held.

    A record ends with its last payload byte and the record mark; one that does not, or lacks a chunk, raises Damaged.
    """
    record, f, left, size, digest, expected = None, {}, 0, 0, hashlib.sha1(), 0
    for name, k, data in chunks:
        if name != record:
            if record is not None:
                raise Damaged(f"the end of {record} is missing")
            if k != 0:
                raise Damaged(f"the beginning of {name} is missing")
            body = data.index(END) + len(END)
            f, data, record, digest, expected = fields_of(data[:body]), data[body:], name, hashlib.sha1(), 0
            size = left = int(f["Content-Length"])
        if k != expected:
            raise Damaged(f"a chunk of {name} is missing")
        expected += 1
        part = data[:left]
        digest.update(part)
        left -= len(part)
        if data[len(part) :] == END and not left:
            yield _result(f, size, digest.hexdigest())
            record = None
        elif len(part) != len(data):
            raise Damaged(f"{name} is longer than it says")
    if record is not None:
        raise Damaged(f"the end of {record} is missing")


RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_TYPES = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_STORED = [("archive", pa.string()), ("block", pa.int64()), ("record", pa.string()), ("chunk", pa.int32()), ("data", pa.binary())]


def _batch(rows: list[tuple], types: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], [n for n, _ in types])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches, one at a time: values leave Arrow only when their row is due."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


def write_archives(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least: int = LEAST, chunk: int = CHUNK, broadcast_digests: int = BROADCAST_DIGESTS
) -> None:
    """Writes one archive for each partition, as a record table at `path`/records, and their numbers of rows at `path`/index.

    Of records with equal payloads of at least `least` bytes, the one with the largest id carries it and the others
    revisit it. A null page is an empty payload. Rows that repeat the largest id of a group all carry the payload; record
    identifiers of repeated ids (null ones too) are told apart by a suffix. Other columns are ignored; an empty df
    writes empty tables.
    """
    small_batches(df.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("payload"))
    pages = pages.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    pages = pages.withColumn("key", F.concat("digest", F.lit(":"), F.when(F.col("size") >= least, F.col("size")).otherwise(-1).cast("string")))
    sized = cut(pages.select("id", F.when(F.col("size") >= least, F.col("key")).alias("key")))
    groups = sized.filter("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("carrier"), F.count(F.lit(1)).alias("members"))
    groups = cut(groups.filter("members > 1 AND carrier IS NOT NULL"))
    repeated = cut(sized.groupBy(F.col("id").alias("id2")).count().filter("count > 1").select("id2", F.lit(True).alias("again")))
    if groups.limit(broadcast_digests + 1).count() <= broadcast_digests:
        rows = pages.join(F.broadcast(groups), "key", "left")
    else:
        rows = join_heavy(pages, groups, "key", "members", F.col("id"))
    if repeated.isEmpty():
        rows = rows.withColumn("again", F.lit(False))
    else:
        rows = rows.join(repeated, F.col("id").eqNullSafe(F.col("id2")), "left")
    revisit = F.col("carrier").isNotNull() & ~F.col("id").eqNullSafe(F.col("carrier"))
    parts = F.when(revisit | (F.col("size") <= chunk), 1).otherwise(F.ceil(F.col("size") / chunk)).cast("int")
    rows = rows.withColumns({"revisit": revisit, "parts": parts}).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    data = F.when(F.col("revisit"), F.lit(b"")).when(F.col("parts") == 1, F.col("payload")).otherwise(F.substring("payload", F.col("part") * chunk + 1, F.lit(chunk)))
    again = F.coalesce("again", F.lit(False)).alias("again")
    rows = rows.select("id", "url", "digest", "size", F.when(F.col("revisit"), F.col("carrier")).alias("refers_to"), "revisit", again, "part", "parts", data.alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack(_rows(batches), f"archive-{TaskContext.get().partitionId():06d}"):
            yield _batch([row], _STORED)

    rows.mapInArrow(run, TABLE).write.option("compression", "zstd").parquet(f"{path}/records")
    stored = df.sparkSession.read.schema(TABLE).parquet(f"{path}/records")
    stored.groupBy("archive").agg(F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/index")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a row for each record, its digest verified.

    Raises Damaged if an archive lacks a row that the index counts; a record that is cut off or altered fails the query.
    """
    small_batches(spark)
    stored = spark.read.schema(TABLE).parquet(f"{path}/records")
    index = spark.read.schema("archive string, rows bigint").parquet(f"{path}/index")
    have = stored.groupBy("archive").agg(F.count_distinct("block").alias("blocks"), F.max("block").alias("last"), F.count(F.lit(1)).alias("have"))
    whole = (F.col("have") == F.col("rows")) & (F.col("blocks") == F.col("rows")) & (F.col("last") == F.col("rows") - 1)
    if bad := index.join(have, "archive", "full").filter(~F.coalesce(whole, F.lit(False))).select("archive").head(1):
        raise Damaged(f"{bad[0].archive} is not whole")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (data,) in _rows(batches):
            yield _batch(list(parse(data)), _TYPES)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in follow(_rows(batches)):
            yield _batch([r], _TYPES)

    large = stored.filter("record IS NOT NULL").select("record", "chunk", "data").repartition("record").sortWithinPartitions("record", "chunk")
    return stored.filter("record IS NULL").select("data").mapInArrow(blocks, RESULT).unionByName(large.mapInArrow(chunks, RESULT))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


SQL = {
    "op9_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS carrier FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND carrier <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND carrier <> page_id THEN carrier END AS refers_to FROM g
"""
}
QUERIES = {"op9_warc": op9_warc}
