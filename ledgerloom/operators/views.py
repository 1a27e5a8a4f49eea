"""Latest-revision views, point reads, pages and idempotent sets over append-only tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codecs import little_endian, outpoint


def current_view(df: DataFrame, keys: list[str], columns: list[str], revision: str = "revision", tie: str | None = None) -> DataFrame:
    """One row a key: the columns of its greatest revision, taken together, and that revision.

    One `max_by` over a struct keeps all columns from one row and combines before the shuffle. `tie` orders rows of
    equal revision.
    """
    order = F.struct(revision, tie) if tie else F.col(revision)
    won = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_won"), F.max(revision).alias(revision))
    return won.select(*keys, *(F.col(f"_won.{c}").alias(c) for c in columns), revision)


def latest_row(df: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """The whole row of the greatest revision of each key; combined before the shuffle, so no key's rows meet in one task."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), revision).alias("_row")).select("_row.*")


def live_accounts(view: DataFrame, status: str = "commitment") -> DataFrame:
    """A current view without winners that are dead; the test must follow the choice of the winner."""
    return view.filter(F.col(status) != "dead")


def keyset_page(df: DataFrame, key: str, after, limit: int, revision: str | None = None, pinned=None) -> DataFrame:
    """The next page after a key; `pinned` hides rows of later revisions than the cursor saw."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    seen = df if pinned is None else df.filter(F.col(revision) <= F.lit(pinned))
    return (seen if after is None else seen.filter(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def pending_outbox(df: DataFrame, now: Column, limit: int) -> DataFrame:
    """Deliveries that are due, oldest first."""
    if not 1 <= limit <= 1000:
        raise ValueError("a delivery batch has 1 to 1000 rows")
    return df.filter((F.col("status") == "pending") & (F.col("available_at") <= now)).orderBy("available_at", "created_at", "idempotency_key").limit(limit)


def once(df: DataFrame, identity: list[str]) -> DataFrame:
    """One row for each identity, whatever was redelivered."""
    return df.dropDuplicates(identity)


def snapshot_changes(current: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `change`: removed (in current only) or added (in the snapshot only)."""
    gone = current.select(*keys).distinct().join(snapshot.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("removed"))
    come = snapshot.select(*keys).distinct().join(current.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(come)


def set_digest(df: DataFrame, keys: list[str], position: str, entry: Column, block: int = 4096) -> DataFrame:
    """SHA-256 of each key's entries in order of position: first over blocks of positions, then over the blocks.

    No task gathers more than `block` entries of a key at once, then one digest a block.
    """
    part = df.withColumn("_entry", entry).withColumn("_block", F.floor(F.col(position) / block))
    joined = lambda order, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), "|")
    blocks = part.groupBy(*keys, "_block").agg(F.sha2(joined(position, "_entry"), 256).alias("_digest"))
    return blocks.groupBy(*keys).agg(F.sha2(joined("_block", "_digest"), 256).alias("state_hash"))


def unspent_digest(outputs: DataFrame, key: str, txid: str, vout: str, value: str, script_id: str) -> DataFrame:
    """key, state_hash, entries: SHA-256 over a key's unspent outputs in the order of their 36-byte outpoints, each with
    its value (eight bytes, least significant first) and script identity.

    The digest is one sequence by nature: a key's rows come sorted into one task, which holds an Arrow batch at a time.
    """
    entry = F.concat(F.col("_point"), little_endian(F.col(value)), F.col(script_id))
    rows = outputs.withColumn("_point", outpoint(F.col(txid), F.col(vout))).select(F.col(key), "_point", entry.alias("_entry"))
    rows = rows.repartition(key).sortWithinPartitions(key, "_point").select(key, "_entry")
    schema = T.StructType([rows.schema[key], T.StructField("state_hash", T.StringType()), T.StructField("entries", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], kind), pa.array([whole.hexdigest()]), pa.array([n], pa.int64())], [key, "state_hash", "entries"])

        own, n, whole, kind, begun = None, 0, hashlib.sha256(), None, False
        for b in batches:
            kind = b.schema.field(0).type
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if begun and k != own:
                    yield told()
                    n, whole = 0, hashlib.sha256()
                own, begun, n = k, True, n + 1
                whole.update(data)
        if begun:
            yield told()

    return rows.mapInArrow(run, schema)
