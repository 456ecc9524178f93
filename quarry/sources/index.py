"""Indexed chunks as a table with a partition for each configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import embed
from quarry.plans import retrieval
from quarry.plans.config import ChunkConfig


def write_index(docs: DataFrame, path: str, config_id: int, config: ChunkConfig, embedder=None, **options) -> None:
    """Chunks and embeds the documents and replaces this configuration's partition;
    others stay as they are. Widths of vectors must agree within a partition."""
    rows = retrieval.index_documents(docs, config, embedder=embedder, **options).withColumn("config_id", F.lit(config_id))
    rows.write.partitionBy("config_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    embed.check_dimensions(read_index(docs.sparkSession, path, config_id))


def read_index(spark: SparkSession, path: str, config_id: int | None = None) -> DataFrame:
    """All chunks, or those of one configuration; only its partition is read."""
    rows = spark.read.parquet(path)
    return rows if config_id is None else rows.filter(F.col("config_id") == config_id)
