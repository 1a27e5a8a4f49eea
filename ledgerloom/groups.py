"""Rows of small groups through Python, many groups a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """df with the rows of each key together in one task, in order (nulls last), groups one after the other.

    Work in Python weighs far more than its bytes, so the tasks are as many as the session's shuffle has or cores there are,
    and Spark does not merge them for being small. They are dealt by a hash of the keys: by the keys alone, Spark would drop
    this exchange over another by the same keys. Nothing here holds a whole group or task in memory.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by = F.col(order) if isinstance(order, str) else order
    return df.repartition(tasks, F.xxhash64(*keys)).sortWithinPartitions(*keys, by.asc_nulls_last())
