"""Feeds: broker records, subscription frames, recorded ranges of blocks and the way back to a known one.

Sockets and node clients are adapters outside the engine; they land files or topics, which these functions read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import graph

#: Topics of a node's subscription (fixed values).
TOPICS = ("rawtx", "rawblock", "sequence")
#: Bytes of a block's header, which its hash covers.
HEADER_BYTES = 80


def broker_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The topic from its first record on; progress is the query's checkpoint. Needs Spark's Kafka package."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("includeHeaders", "true").load()


def broker_records(observations: DataFrame) -> DataFrame:
    """key, value, headers of each distinct observation, as Spark's Kafka sink takes them (with acks of all replicas).

    Records of a source share a key, so they keep their order; the header event_id names the observation.
    """
    one = observations.dropDuplicates(["observation_id"])
    header = F.struct(F.lit("event_id").alias("key"), F.col("observation_id").cast("binary").alias("value"))
    return one.select(F.col("source_id").cast("binary").alias("key"), F.col("payload").alias("value"), F.array(header).alias("headers"))


def new_events(records: DataFrame, published: DataFrame) -> DataFrame:
    """Records whose event no published one has: publishing again changes nothing."""
    event = F.element_at("headers", 1)["value"]
    return records.withColumn("_event", event).join(published.select(event.alias("_event")).distinct(), "_event", "left_anti").drop("_event")


def notifications(frames: DataFrame, parts: str, most: int) -> DataFrame:
    """frames with topic, body, transport_sequence and `fault`, from an array of three binary parts.

    The last part is four bytes, least significant first. A faulty frame has nulls in the three columns.
    """
    part = lambda k: F.get(F.col(parts), F.lit(k))
    topic = part(0).cast("string")
    fault = (
        F.when(F.coalesce(F.size(parts), F.lit(-1)) != 3, "part_count")
        .when(~F.coalesce(topic.isin(*TOPICS), F.lit(False)), "topic")
        .when(~F.coalesce(F.octet_length(part(1)) <= most, F.lit(False)), "body_too_large")
        .when(~F.coalesce(F.octet_length(part(2)) == 4, F.lit(False)), "sequence")
    )
    good = lambda c: F.when(F.col("fault").isNull(), c)
    number = F.conv(codecs.reversed_bytes(F.hex(part(2))), 16, 10).cast("long")
    return frames.withColumn("fault", fault).withColumns({"topic": good(topic), "body": good(part(1)), "transport_sequence": good(number)})


def backfill(ranges: DataFrame, heights: DataFrame, raw: DataFrame) -> DataFrame:
    """source_id, height, block_hash, raw_block and `fault` of every height of the ranges (source_id, start, end).

    heights (height, block_hash) tells the hash, raw (block_hash, raw_block) the bytes, whose first 80 must have that
    hash. A range becomes one row a height before the joins, so no task fetches a range.
    """
    wanted = ranges.filter("start <= end").select("source_id", F.explode(F.sequence("start", "end")).alias("height"))
    met = wanted.join(heights.select("height", "block_hash"), "height", "left").join(raw.select("block_hash", "raw_block"), "block_hash", "left")
    actual = codecs.display_hash(F.substring("raw_block", 1, HEADER_BYTES))
    fault = F.when(F.col("block_hash").isNull(), "unknown_height").when(F.col("raw_block").isNull(), "missing_block").when(actual != F.col("block_hash"), "hash_mismatch")
    return met.select("source_id", "height", "block_hash", "raw_block", fault.alias("fault"))


def recovered(blocks: DataFrame, node: str, parent: str, known: DataFrame, tips: DataFrame) -> DataFrame:
    """Rows of blocks from the tips back to, and without, the first known one, with `anchored`: whether its parent is known.

    Known blocks leave the graph before the walk, so it ends at them. Ordered by height, a gap is closed from below; a
    path whose lowest block is not anchored does not reach a known one.
    """
    seen = known.toDF("_known").distinct()
    fresh = blocks.join(seen, F.col(node) == F.col("_known"), "left_anti")
    path = graph.above(fresh, node, parent, tips).select(F.col("node").alias("_node"))
    taken = fresh.join(path, F.col(node) == F.col("_node"), "left_semi")
    return taken.join(seen, F.col(parent) == F.col("_known"), "left").withColumn("anchored", F.col("_known").isNotNull()).drop("_known")


def fixture_observation(source: str, sequence: Column, fixture: Column, value: Column) -> Column:
    """Payload of the deterministic source: JSON with the sequence it was given."""
    return F.to_json(F.struct(fixture.alias("fixture_id"), value.alias("value"), sequence.alias("source_sequence"), F.lit(source).alias("source_id")))
