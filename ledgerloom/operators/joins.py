"""Range, overlap, divergence and membership joins. Ranges of one key never meet all its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _range_before(facts: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, take: list[str]) -> DataFrame:
    """facts with `_range`, the columns `take` of the range of their keys that begins last at or before `at`.

    Both sides in one order of key and place, where each fact sees the range before it: one shuffle and one sort, however
    many ranges a key has. Null places see none.
    """
    carried = F.struct(*(F.col(c) for c in facts.columns))
    kind = ranges.select(F.struct(*take).alias("x")).schema["x"].dataType
    a = facts.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.col(at).alias("_at"), F.lit(1).alias("_side"), carried.alias("_fact"), F.lit(None).cast(kind).alias("_range"))
    b = ranges.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.col(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(facts.select(carried.alias("x")).schema["x"].dataType).alias("_fact"), F.struct(*take).alias("_range"))
    order = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_range", F.last("_range", ignorenulls=True).over(order)).filter("_side = 1")
    return met.select("_fact.*", F.when(F.col("_at").isNotNull(), F.col("_range")).alias("_range"))


def committed(observations: DataFrame, commits: DataFrame) -> DataFrame:
    """Observations that a commit of their session covers, with the commit's columns. Commits of a session do not overlap."""
    take = ["last_collector_sequence", "durable_at_unix_ns", "commit_hash"]
    met = _range_before(observations, commits, ["source_session_id"], "collector_sequence", "first_collector_sequence", take)
    return met.filter(F.col("collector_sequence") <= F.col("_range.last_collector_sequence")).select(*observations.columns, "_range.durable_at_unix_ns", "_range.commit_hash")


def decoder_for(facts: DataFrame, deployments: DataFrame, key: str, at: str) -> DataFrame:
    """facts with `decoder_version` of the deployment whose key matches and whose range [valid_from, valid_to or open]
    holds `at`; null where none does (unknown). Deployments of one key must not overlap."""
    met = _range_before(facts, deployments, [key], at, "valid_from", ["valid_to", "decoder_version"])
    holds = F.col("_range.valid_to").isNull() | (F.col(at) <= F.col("_range.valid_to"))
    return met.select(*facts.columns, F.when(F.col(key).isNotNull() & holds, F.col("_range.decoder_version")).alias("decoder_version"))


def overlaps(df: DataFrame, keys: list[str], start: str, end: str, identity: str, width: int = 16) -> DataFrame:
    """Pairs (a, b), a < b, of one key's intervals that share a point; a null end is open.

    The axis is cut into cells of `width`: an interval stands in every cell it touches (an open one up to the key's last
    start), and a pair is told in the first cell that both touch, so a key with many intervals is many small groups.
    """
    last = df.groupBy(*keys).agg(F.max(start).alias("_last"))
    cell = lambda c: F.floor(c / width)
    until = F.greatest(F.col(start), F.coalesce(F.least(F.col(end), F.col("_last")), F.col("_last")))
    placed = df.join(last, keys).select(*keys, F.col(identity).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"), F.explode(F.sequence(cell(F.col(start)), cell(until))).alias("_cell"))
    a, b = (placed.select(*keys, "_cell", F.col("id").alias(n), F.col("s").alias(f"s{n}"), F.col("e").alias(f"e{n}")) for n in "ab")
    meet = (F.col("eb").isNull() | (F.col("sa") <= F.col("eb"))) & (F.col("ea").isNull() | (F.col("sb") <= F.col("ea")))
    first = F.col("_cell") == cell(F.greatest("sa", "sb"))
    return a.join(b, [*keys, "_cell"]).filter((F.col("a") < F.col("b")) & meet & first).select(*keys, "a", "b")


def divergence(df: DataFrame, keys: list[str], provider: str, value: str) -> DataFrame:
    """Keys that providers report with more than one value: the number of values and the providers, sorted."""
    seen = df.groupBy(*keys).agg(F.min(value).alias("_least"), F.max(value).alias("_most"), F.sort_array(F.collect_set(provider)).alias("providers"))
    return seen.filter("_least != _most").drop("_least", "_most")


def unspent(outputs: DataFrame, spends: DataFrame, on: list[str]) -> DataFrame:
    return outputs.join(spends.select(*on), on, "left_anti")


def conflicts(inputs: DataFrame, spent: list[str], tx: str, arrival: str) -> DataFrame:
    """Pairs of different transactions that spent the same output: the later points to the earlier.

    Spenders of one output are few; the join key is the output, so a busy sender is no hot key.
    """
    a, b = inputs.alias("a"), inputs.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in spent]
    return a.join(b, [*same, F.col(f"a.{arrival}") > F.col(f"b.{arrival}"), F.col(f"a.{tx}") != F.col(f"b.{tx}")]).select(*(F.col(f"a.{c}") for c in spent), F.col(f"a.{tx}").alias("txid"), F.col(f"b.{tx}").alias("conflicting_txid"))


def membership(df: DataFrame, subject: str, observer: str, healthy: list[str], seen_at: str, quorum: int) -> DataFrame:
    """For each subject over the healthy observers: who has it, since when, and the union, intersection and quorum views."""
    ok = df.filter(F.col(observer).isin(healthy))
    each = ok.groupBy(subject).agg(F.sort_array(F.collect_set(observer)).alias("present_sources"), F.min(seen_at).alias("first_seen")).withColumn("present", F.size("present_sources").cast("long"))
    n = len(healthy)
    return each.select(subject, "present", F.array_join("present_sources", ",").alias("present_sources"), "first_seen", (F.col("present") > 0).alias("in_union"), (F.lit(n > 0) & (F.col("present") == n)).alias("in_intersection"), (F.lit(quorum > 0) & (F.col("present") >= quorum)).alias("in_quorum"))


def observer_quality(sources: DataFrame, max_offset: int, keys: list[str] | None = None) -> DataFrame:
    """`quality` of each set of observers: unavailable without a healthy one, degraded if any is unhealthy or its clock
    is off by more than max_offset, else complete."""
    bad_clock = F.abs("clock_offset") > max_offset
    total = sources.groupBy(*(keys or [])).agg(F.count_if(F.col("health") == "healthy").alias("healthy"), F.count_if((F.col("health") != "healthy") | bad_clock).alias("bad"))
    return total.select(*(keys or []), "healthy", F.when(F.col("healthy") == 0, "unavailable").when(F.col("bad") > 0, "degraded").otherwise("complete").alias("quality"))
