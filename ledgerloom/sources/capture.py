"""Capture of source messages as observations, and their way to broker and archive, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import observation_ids
from ..operators import guards, normalize, sequences
from . import feeds, tables

#: Bytes that a message and its cursor may have, and the flag of what a node was asked for after a gap (fixed values).
MOST_PAYLOAD, MOST_CURSOR = 64 << 20, 1024
RECOVERED = "recovered_by_rpc"
SESSION = ("source_id", "source_session_id")


def capture_rules(most_payload: int = MOST_PAYLOAD) -> dict[str, Column]:
    """Rules of a message: a visible identity, a session of 16 bytes, and bounds of payload and cursor."""
    return {
        "source_identity": guards.is_graphic(F.col("source_id")) & guards.is_graphic(F.col("chain")) & guards.is_graphic(F.col("network")),
        "session": F.octet_length("source_session_id") == 16,
        "payload_too_large": F.octet_length("payload") <= most_payload,
        "cursor_too_large": F.coalesce(F.octet_length("source_cursor"), F.lit(0)) <= MOST_CURSOR,
    }


def captured(messages: DataFrame, taken: DataFrame, arrival: str, width: int | None = None, most_payload: int = MOST_PAYLOAD) -> tuple[DataFrame, DataFrame]:
    """Observations of the messages that may be captured, and the others with `faults`.

    messages has source_id, source_session_id, chain, network, channel, source_message_type, payload, source_cursor and the
    order of arrival in a session. taken (source_id, source_session_id, next) tells where a session's numbers go on; without a row
    they begin at 0. Refused messages take no number. `width` splits a long session by arrival (see
    `sequences.collector_sequence`). Identity and payload digest are derived, and never read from the message.
    """
    good, bad = normalize.split(messages, **capture_rules(most_payload))
    numbered = sequences.collector_sequence(good, list(SESSION), arrival, width)
    begun = taken.select(*SESSION, F.col("next").alias("_next"))
    at = numbered.join(begun, list(SESSION), "left").withColumn("collector_sequence", F.col("sequence") + F.coalesce("_next", F.lit(0)))
    made = {
        "payload_hash": F.unhex(F.sha2("payload", 256)),
        "observation_id": F.unhex(observation_ids(F.col("source_id"), F.col("source_session_id"), F.col("collector_sequence"), F.col("payload"))),
        "quality_flags": F.when(F.col("channel") == "rpc", F.array(F.lit(RECOVERED))).otherwise(F.array().cast("array<string>")),
    }
    return at.withColumns(made).drop("sequence", "_next", arrival), bad


def stored(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the archive; its folder is made when it is first read."""
    empty = spark.createDataFrame([], schema)
    path = f"{root}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(empty.schema).parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else empty


MANIFEST = "source_id string, source_session_id binary, first_collector_sequence long, last_collector_sequence long, records long, digest string, batch string, previous_manifest_hash string, manifest_hash string"
CHECKPOINT = "consumer string, source_id string, source_session_id binary, last_collector_sequence long"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Committed manifests, one a session and batch, in a hash chain a session."""
    return stored(spark, root, "manifests", MANIFEST)


def checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """The highest sequence of each consumer (broker or archive) and session."""
    every = stored(spark, root, "checkpoints", CHECKPOINT)
    return every.groupBy("consumer", *SESSION).agg(F.max("last_collector_sequence").alias("last_collector_sequence"))


def _ranges(observations: DataFrame) -> DataFrame:
    """A row a session: range, records and a digest that no order or partitioning changes, combined before the shuffle."""
    n = F.col("collector_sequence")
    return observations.groupBy(*SESSION).agg(
        F.min(n).alias("first_collector_sequence"), F.max(n).alias("last_collector_sequence"), F.count(F.lit(1)).alias("records"),
        tables.bag_digest(F.hex("observation_id")).alias("digest"),
    )


def _require(df: DataFrame, rule: Column, why: str) -> None:
    """One aggregate over the rows; raises if any breaks the rule, before a later step can be seen."""
    if df.agg(F.count_if(~F.coalesce(rule, F.lit(False))).alias("n")).first()["n"]:
        raise ValueError(why)


def publish_and_archive(batch: DataFrame, name: str, root: str, publish: Callable[[DataFrame], None]) -> None:
    """Body of a `foreachBatch`: publish, checkpoint, stage, verify, commit, checkpoint; each step only after the one before.

    batch has whole observations, one contiguous range a session; it is read several times, so persist it. `publish` takes
    `feeds.broker_records` and returns once they are durable; it goes by event id, since a batch may come again. A range that
    is committed with the same digest is not staged again, its archive checkpoint only advances. Objects lie in a folder
    named by the batch (`name`, its number) and what of it is new, so a batch that failed half way is staged over itself,
    and never over what is committed. What differs from what is committed, overlaps it or leaves a gap fails the query, and
    a segment then stays unreclaimed.
    """
    spark = batch.sparkSession
    offered = _ranges(batch)
    whole = F.col("records") == F.col("last_collector_sequence") - F.col("first_collector_sequence") + 1
    _require(offered, whole, "a session's numbers have a gap or repeat in the batch")
    publish(feeds.broker_records(batch))
    point = lambda df, consumer: df.select(F.lit(consumer).alias("consumer"), *SESSION, "last_collector_sequence")
    point(offered, "broker").write.mode("append").parquet(f"{root}/checkpoints")

    there = manifests(spark, root)
    same = [*SESSION, "first_collector_sequence", "last_collector_sequence", "digest"]
    new = offered.join(there.select(*same), same, "left_anti")
    last = F.struct("last_collector_sequence", "manifest_hash")
    heads = there.groupBy(*SESSION).agg(F.max(last).alias("_head"))
    new = new.join(heads, list(SESSION), "left").withColumn("previous_manifest_hash", F.col("_head.manifest_hash"))
    follows = F.col("_head").isNull() | (F.col("first_collector_sequence") == F.col("_head.last_collector_sequence") + 1)
    _require(new, follows, "a range overlaps, repeats or does not follow what is committed")

    mark = F.concat_ws("|", "source_id", F.hex("source_session_id"), "first_collector_sequence", "digest")
    fresh = new.agg(F.count(F.lit(1)).alias("sessions"), F.sha2(tables.bag_digest(mark), 256).alias("mark")).first()
    if fresh["sessions"]:
        _stage_and_commit(batch, new, f"b{name}-{fresh['mark'][:16]}", root)
    point(offered, "archive").write.mode("append").parquet(f"{root}/checkpoints")


def _stage_and_commit(batch: DataFrame, new: DataFrame, name: str, root: str) -> None:
    """Writes the observations of new ranges, reads them again, and only then lets their manifests be seen."""
    spark, objects = batch.sparkSession, f"{root}/objects/batch={name}"
    batch.join(new.select(*SESSION), list(SESSION), "left_semi").write.mode("overwrite").option("compression", "zstd").parquet(objects)
    reread = _ranges(spark.read.schema(batch.schema).parquet(objects)).withColumnRenamed("digest", "_digest").select(*SESSION, "_digest")
    staged = new.join(reread, list(SESSION), "left")
    _require(staged, F.col("_digest") == F.col("digest"), "what was staged is not what was offered")
    text = ["first_collector_sequence", "last_collector_sequence", "records", "digest"]
    own = F.sha2(F.concat_ws("|", "source_id", F.lower(F.hex("source_session_id")), *text, F.coalesce("previous_manifest_hash", F.lit(""))), 256)
    named = new.withColumns({"batch": F.lit(name), "manifest_hash": own})
    named.select(*(c.split()[0] for c in MANIFEST.split(", "))).write.mode("append").parquet(f"{root}/manifests")


def archived(spark: SparkSession, root: str, schema) -> DataFrame:
    """Observations that a manifest covers; what was staged and never committed is not seen."""
    objects = spark.read.schema(schema).option("basePath", f"{root}/objects").parquet(f"{root}/objects")
    covered = manifests(spark, root).select(*SESSION, "batch")
    return objects.withColumn("batch", F.col("batch").cast("string")).join(covered, [*SESSION, "batch"], "left_semi").drop("batch")
