"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, and on a local master only, a new temporary folder."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set, and executors can't see the driver's temporary folder")
    context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="tickloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df as written to the shared folder, in the same partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
