"""Fact tables: installing, appending, reading back, removing; manifests that join the committed chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that say where a fact comes from.
LINEAGE = ("source_id", "source_session_id", "observation_id", "parser_version")


def install(spark: SparkSession, database: str, tables: dict[str, str]) -> None:
    """Database and Parquet tables (name to DDL columns) that are not there yet; installing again changes nothing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def append(facts: DataFrame, name: str) -> None:
    """Adds facts to a table by name of column; revisions stay beside each other, the current views choose."""
    columns = facts.sparkSession.table(name).columns
    facts.select(*columns).write.insertInto(name)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a line; a line that does not fit the schema fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def fact(view: DataFrame, column: str, value: object) -> DataFrame:
    """Point lookup; the predicate reaches the scan, so sorted or bucketed files are skipped by their statistics."""
    return view.filter(F.col(column) == F.lit(value))


def with_lineage(facts: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns, with the lineage as one nested column."""
    return facts.select(*columns, F.struct(*LINEAGE).alias("lineage"))


def without(facts: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Facts but those whose key is among the given ones; a null key stays."""
    return facts.join(keys.select(column).filter(F.col(column).isNotNull()).distinct(), column, "left_anti")


def offered_manifests(committed: DataFrame, offered: DataFrame, key: str, first: str, last: str, own: str, previous: str) -> DataFrame:
    """offered with `outcome`: committed, duplicate, chain_mismatch or overlap; at most one new manifest a session.

    A manifest already there is a duplicate, wherever it stands. A new one names the session's head, that of the
    greatest last number, as its forerunner (none for the first) and begins above it. Heads are aggregated before they
    meet the offers.
    """
    heads = committed.groupBy(key).agg(F.max_by(own, last).alias("_head"), F.max(last).alias("_last"))
    there = committed.select(F.col(own).alias("_there")).distinct()
    met = offered.join(there, F.col(own) == F.col("_there"), "left").join(heads, key, "left")
    outcome = F.when(F.col("_there").isNotNull(), "duplicate").when(~F.col(previous).eqNullSafe(F.col("_head")), "chain_mismatch").when(F.col(first) <= F.col("_last"), "overlap").otherwise("committed")
    return met.withColumn("outcome", outcome).drop("_there", "_head", "_last")


def bag_digest(row: Column) -> Column:
    """Aggregate: a digest of a bag of rows that is the same for every order and partitioning of them.

    The first 60 bits and the next 60 of each row's SHA-256 are summed, so partial sums meet in the shuffle and no key
    is gathered. Nulls count as the text `null`.
    """
    sha = F.sha2(F.coalesce(row.cast("string"), F.lit("null")), 256)
    total = lambda at: F.sum(F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", total(1), total(16))


def replay_digest(facts: DataFrame, keys: list[str], row: Column) -> DataFrame:
    """keys, facts, digest: what two replays of the same input must have in common."""
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("facts"), bag_digest(row).alias("digest"))
