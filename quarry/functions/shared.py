"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a local folder only where the
    session names none, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named or "/tmp/checkpoints/quarry")
    return f"{(named or '/tmp/checkpoints/quarry').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to that folder."""
    shared_path(df.sparkSession, "")
    return df.checkpoint()
