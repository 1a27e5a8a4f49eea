"""Window operators over sequences and revisions: order within a source, never wall clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def _after_parts(df: DataFrame, keys: list[str], order: str, width: int, total: Column, combine: Callable, own: Callable) -> DataFrame:
    """df with `_own`, a window's value within the row's part of its session, and `_carry`, what the parts before come to.

    A part is so many units of a whole-number order; `total` sums one up, and only these sums of a session meet.
    """
    by = [*keys, "_part"]
    part = df.withColumn("_part", F.floor(F.col(order) / width))
    before = combine("_n").over(_by(keys, "_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = part.groupBy(*by).agg(total.alias("_n")).withColumn("_carry", before)
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by]
    met = part.withColumn("_own", own(_by(by, order))).alias("p").join(sums.alias("s"), on)
    return met.select(*(F.col(f"p.{c}") for c in (*df.columns, "_own")), "s._carry")


def collector_sequence(df: DataFrame, keys: list[str], order: str, width: int | None = None) -> DataFrame:
    """`sequence` from 0, in order of arrival, across the channels of a session.

    With `width` a session is cut every so many units of a whole-number order: parts are numbered on their own and begin
    where the counts of those before them end, so a long session is no single task.
    """
    if width is None:
        return df.withColumn("sequence", (F.row_number().over(_by(keys, order)) - 1).cast("long"))
    parts = _after_parts(df, keys, order, width, F.count(F.lit(1)), F.sum, lambda w: F.row_number().over(w))
    return parts.select(*df.columns, (F.col("_own") - 1 + F.coalesce("_carry", F.lit(0))).cast("long").alias("sequence"))


def gaps(df: DataFrame, keys: list[str], sequence: str, width: int | None = None) -> DataFrame:
    """keys, missing_first, missing_last for each run of missing numbers; repeats are no gap.

    With `width` a session is cut every so many numbers: gaps within a part are found part by part, those between parts
    from the least and greatest number of each, so a long session is no single task.
    """
    told = lambda found, at: found.filter(F.col(at) > F.col("_before") + 1).select(*keys, (F.col("_before") + 1).alias("missing_first"), (F.col(at) - 1).alias("missing_last"))
    if width is None:
        return told(df.withColumn("_before", F.lag(sequence).over(_by(keys, sequence))), sequence)
    own, part = [*keys, "_part"], df.select(*keys, sequence, F.floor(F.col(sequence) / width).alias("_part"))
    inside = told(part.withColumn("_before", F.lag(sequence).over(_by(own, sequence))), sequence)
    ends = part.groupBy(*own).agg(F.min(sequence).alias("_least"), F.max(sequence).alias("_most"))
    return inside.unionByName(told(ends.withColumn("_before", F.lag("_most").over(_by(keys, "_part"))), "_least"))


def regressions(df: DataFrame, keys: list[str], order: str, value: str, width: int | None = None) -> DataFrame:
    """df with `highest` (before this row) and `accepted`: the value exceeds it, or is the first. `width` cuts long sessions."""
    last = lambda w: F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if width is None:
        told = df.withColumn("highest", last(_by(keys, order)))
    else:
        parts = _after_parts(df, keys, order, width, F.max(value), F.max, last)
        told = parts.select(*df.columns, F.greatest("_own", "_carry").alias("highest"))
    return told.withColumn("accepted", F.col("highest").isNull() | (F.col(value) > F.col("highest")))


def runs(df: DataFrame, keys: list[str], order: str, hit: Column) -> DataFrame:
    """df with `streak`: rows in a row, up to this one, for which `hit` holds; 0 where it does not."""
    marked = df.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int"))
    marked = marked.withColumn("_island", F.sum(1 - F.col("_hit")).over(_by(keys, order)))
    return marked.withColumn("streak", F.sum("_hit").over(_by([*keys, "_island"], order)).cast("long")).drop("_hit", "_island")


def intervals(df: DataFrame, keys: list[str], order: str, bad: Column) -> DataFrame:
    """keys, interval_start, interval_end, failures: a row for each unbroken run of bad rows; ended by the next good one,
    or null while it lasts."""
    marked = df.withColumn("_bad", bad).withColumn("_next", F.lead(order).over(_by(keys, order)))
    marked = marked.withColumn("_island", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(_by(keys, order))).filter("_bad")
    return marked.groupBy(*keys, "_island").agg(F.min(order).alias("interval_start"), F.max_by("_next", order).alias("interval_end"), F.count(F.lit(1)).alias("failures")).drop("_island")


def toggles(df: DataFrame, keys: list[str], order: str, on: Column) -> DataFrame:
    """Rows that change a key's state, with `epoch` and `epoch_revision` (1 when it begins, 2 when it ends).

    Turning on twice or off while off changes nothing and is not returned.
    """
    marked = df.withColumn("_on", on)
    marked = marked.withColumn("_was", F.coalesce(F.lag("_on").over(_by(keys, order)), F.lit(False))).filter("_on != _was")
    epoch = F.sum(F.col("_on").cast("int")).over(_by(keys, order)).cast("long")
    return marked.withColumn("epoch", epoch).withColumn("epoch_revision", F.when(F.col("_on"), 1).otherwise(2)).drop("_on", "_was")


def chain_breaks(df: DataFrame, keys: list[str], order: str, parent: str, own: str) -> DataFrame:
    """Rows whose parent hash is not the hash of the row before."""
    before = F.lag(own).over(_by(keys, order))
    return df.withColumn("_own_before", before).filter(F.col("_own_before").isNotNull() & ~F.col(parent).eqNullSafe(F.col("_own_before"))).drop("_own_before")


def as_of(df: DataFrame, keys: list[str], order: str, value: str, when: Column, name: str) -> DataFrame:
    """df with the last `value` of rows for which `when` holds, up to and with this row."""
    return df.withColumn(name, F.last(F.when(when, F.col(value)), ignorenulls=True).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
