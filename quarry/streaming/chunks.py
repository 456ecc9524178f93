"""Chunking of arriving documents. Chunking needs no state, so append mode does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import chunkers


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, version long", form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def chunk_stream(docs: DataFrame, strategy: str = "token", chunk_size: int = 200, overlap: int = 20, **options) -> DataFrame:
    """The same transformation as for a table."""
    return chunkers.chunk(docs, strategy, chunk_size, overlap, **options)


def newest(docs: DataFrame, key: str = "doc_id", version: str = "version") -> DataFrame:
    """Of each document's versions the newest: an aggregate, so a document that changes
    very often is summed before it is shuffled."""
    rest = [c for c in docs.columns if c != key]
    return docs.groupBy(key).agg(F.max(F.struct(version, *(c for c in rest if c != version))).alias("_n")).select(key, *(F.col(f"_n.{c}").alias(c) for c in rest))


def write_newest_chunks(docs: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "300 milliseconds", available_now: bool = False, **options) -> StreamingQuery:
    """Chunks the newest version of each document of every micro-batch; the trigger's
    interval gathers edits that follow each other closely. `write` gets (chunks,
    batch number) and should replace a document's chunks, so a repeated batch does
    no harm."""

    def batch(rows: DataFrame, number: int) -> None:
        write(chunk_stream(newest(rows), id_cols=("doc_id", "version"), **options), number)

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops running jobs of a tag that spark.addTag() has set."""
    spark.interruptTag(tag) if hasattr(spark, "interruptTag") else spark.sparkContext.cancelJobsWithTag(tag)


def latest_by_window(docs: DataFrame, key: str = "doc_id", order: str = "version") -> DataFrame:
    """As newest(), for columns that can't be compared, such as maps."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return docs.withColumn("_r", rank).filter("_r = 1").drop("_r")
