"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder below spark.checkpoint.dir, or, in local mode only, a temporary one.

    It is deleted when the application ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="ledgerloom-")
        sc.setCheckpointDir(where)
    have = sc.getCheckpointDir()
    if have not in _MARKED:
        at = spark._jvm.org.apache.hadoop.fs.Path(have)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        _MARKED.add(have)
    return have


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
