"""Archive objects: length-prefixed committed observations under Zstandard, manifests in a hash chain, replay by manifest."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import archive_hour
from ..operators import sequences
from . import wire
from .segments import COMMITTED_SCHEMA, files, to_batches

LEVEL = 3
_BYTES = [str(i) for i in range(256)]
#: What one object has in common.
PARTITION = ("chain", "network", "source_id", "channel", "source_session_id")


def pack(rows: list[dict]) -> bytes:
    out = bytearray()
    for r in rows:
        record = wire.encode(wire.COMMITTED, {"observation": wire.encode(wire.OBSERVATION, r), "durable_at_unix_ns": r["durable_at_unix_ns"], "wal_commit_hash": r["wal_commit_hash"]})
        out += struct.pack(">I", len(record)) + record
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress(bytes(out))


def unpack(data: bytes) -> Iterator[dict]:
    """Rows of an object, as they come out of the decompressor; ValueError for a cut frame or a record without observation."""
    with zstandard.ZstdDecompressor().stream_reader(data) as stream:
        while head := stream.read(4):
            size = struct.unpack(">I", head)[0] if len(head) == 4 else -1
            record = stream.read(size) if size >= 0 else b""
            if size < 0 or len(record) < size:
                raise ValueError("truncated frame")
            r = wire.decode(wire.COMMITTED, record)
            if not r["observation"]:
                raise ValueError("a record holds no observation")
            yield wire.decode(wire.OBSERVATION, r["observation"]) | {"durable_at_unix_ns": r["durable_at_unix_ns"], "wal_commit_hash": r["wal_commit_hash"]}


def path_part_is_safe(part: Column) -> Column:
    return (part != "") & ~part.isin(".", "..") & ~part.rlike(r"[/\\\x00-\x1f\x7f]")


def object_key() -> Column:
    """Key of an object over its batch's columns."""
    part = lambda name, column: F.concat(F.lit(f"/{name}="), F.col(column).cast("string"))
    session = F.lower(F.hex("source_session_id"))
    return F.concat(F.lit("raw"), part("chain", "chain"), part("network", "network"), part("source", "source_id"), part("channel", "channel"), part("date", "date"), F.format_string("/hour=%02d", "hour"), F.lit("/part-"), session, F.lit("-"), F.col("first_collector_sequence").cast("string"), F.lit("-"), F.col("last_collector_sequence").cast("string"), F.lit(".bin.zst"))


def batches(observations: DataFrame) -> DataFrame:
    """One row a batch: partition, date, hour, first and last sequence, record count, key, and whether it can be archived:
    safe path parts and a sequence without a gap or repeat. Aggregates only, so a batch never gathers in one task."""
    at = archive_hour(F.col("observed_at_unix_ns"))
    named = observations.select(*PARTITION, "collector_sequence", at["date"].alias("date"), at["hour"].alias("hour"))
    n = named.groupBy(*PARTITION, "date", "hour").agg(F.min("collector_sequence").alias("first_collector_sequence"), F.max("collector_sequence").alias("last_collector_sequence"), F.count(F.lit(1)).alias("record_count"), F.count_distinct("collector_sequence").alias("_distinct"))
    safe = [path_part_is_safe(F.col(c)) for c in PARTITION[:4]]
    whole = (F.col("record_count") == F.col("last_collector_sequence") - F.col("first_collector_sequence") + 1) & (F.col("_distinct") == F.col("record_count"))
    return n.withColumn("archivable", safe[0] & safe[1] & safe[2] & safe[3] & (F.octet_length("source_session_id") == 16) & whole).withColumn("object_key", object_key()).drop("_distinct")


def write_parquet(observations: DataFrame, path: str, mode: str = "append") -> None:
    """Our own archive: Parquet under Zstandard, by chain, network, source, channel, date and hour."""
    at = archive_hour(F.col("observed_at_unix_ns"))
    observations.withColumns({"source": F.col("source_id"), "date": at["date"], "hour": at["hour"]}).write.mode(mode).option("compression", "zstd").partitionBy("chain", "network", "source", "channel", "date", "hour").parquet(path)


def _numbers(digest: Column) -> Column:
    """A digest as a JSON list of byte values; null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f"[{','.join(map(_BYTES.__getitem__, v))}]")

    return run(digest)


def manifest_json() -> Column:
    """The commit marker: digests as lists of byte values, keys in fixed order, no spaces."""
    text = lambda c: F.col(c).cast("string")
    parts = [
        ("source_session_id", _numbers(F.col("source_session_id"))), ("first_collector_sequence", text("first_collector_sequence")), ("last_collector_sequence", text("last_collector_sequence")),
        ("object_key", F.concat(F.lit('"'), F.regexp_replace("object_key", r'([\\"])', r"\\$1"), F.lit('"'))), ("object_sha256", _numbers(F.col("object_sha256"))), ("compressed_bytes", text("compressed_bytes")),
        ("record_count", text("record_count")), ("previous_manifest_hash", F.coalesce(_numbers(F.col("previous_manifest_hash")), F.lit("null"))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts)), F.lit("}"))


def manifest_hash() -> Column:
    return F.unhex(F.sha2(manifest_json(), 256))


def manifest_faults(manifests: DataFrame) -> DataFrame:
    """Manifests of a session that break the chain (wrong previous hash) or the order (a range that is empty, overlaps or leaves a gap)."""
    w = sequences._by(["source_session_id"], "first_collector_sequence")
    m = manifests.withColumn("manifest_hash", manifest_hash())
    m = m.withColumns({"_hash": F.lag("manifest_hash").over(w), "_last": F.lag("last_collector_sequence").over(w)})
    first, last = F.col("first_collector_sequence"), F.col("last_collector_sequence")
    fault = F.when(last < first, "empty_range").when(F.col("_last") >= first, "overlap").when(F.col("_last") + 1 < first, "gap").when(~F.col("_hash").eqNullSafe(F.col("previous_manifest_hash")), "chain")
    return m.withColumn("fault", fault).filter("fault IS NOT NULL").drop("_hash", "_last")


def replay(spark: SparkSession, root: str, manifests: DataFrame) -> DataFrame:
    """Committed observations of the objects the manifests name; an object of another length or digest fails the query.

    Objects are read one by one in their tasks; only length and digest of the manifests travel to the join.
    """
    schema = f"object_key string, {COMMITTED_SCHEMA}"
    named = manifests.select("object_key", "object_sha256", "compressed_bytes", F.col("record_count").cast("long").alias("record_count"))
    stored = files(spark, f"{root}/raw").withColumn("object_key", F.regexp_extract("path", "(raw/chain=.*)$", 1))
    met = named.join(stored, "object_key", "left").select("object_key", "object_sha256", "compressed_bytes", "record_count", "content")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for key, digest, size, count, content in zip(*(b.column(i) for i in range(5)), strict=True):
                data = content.as_py()
                if data is None or len(data) != size.as_py() or hashlib.sha256(data).digest() != digest.as_py():
                    raise ValueError(f"missing or altered: {key.as_py()}")
                seen = 0
                for batch in to_batches(({"object_key": key.as_py()} | row for row in unpack(data)), schema):
                    seen += batch.num_rows
                    yield batch
                if seen != count.as_py():
                    raise ValueError(f"{seen} records, not {count.as_py()}: {key.as_py()}")

    return met.mapInArrow(run, schema)
