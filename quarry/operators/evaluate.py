"""Batch evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.5


def per_query(queries: DataFrame, hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query columns, top_score, avg_score, chunks_count, matches): matches are
    (text, score) by rank, texts of 100 characters. Queries without hits have zeros."""
    match = F.struct("rank", F.substring("text", 1, 100).alias("text"), F.col("similarity").alias("score")) if "text" in hits.columns else F.struct("rank", F.lit("").alias("text"), F.col("similarity").alias("score"))
    found = hits.groupBy(query_id).agg(F.max("similarity").alias("top_score"), F.avg("similarity").alias("avg_score"), F.count("*").cast("int").alias("chunks_count"), F.array_sort(F.collect_list(match)).alias("m"))
    out = queries.join(found, query_id, "left")
    matches = F.coalesce(F.transform("m", lambda x: F.struct(x["text"].alias("text"), x["score"].alias("score"))), F.array().cast("array<struct<text:string,score:double>>"))
    return out.withColumn("matches", matches).drop("m").fillna({"top_score": 0.0, "avg_score": 0.0, "chunks_count": 0})


def batch_metrics(results: DataFrame, threshold: float = THRESHOLD, by: tuple[str, ...] = ()) -> DataFrame:
    """(total_queries, avg_top_score, avg_retrieval_score, hit_rate); a hit reaches the
    threshold. Zeros without queries."""
    zero = F.lit(0.0)
    return results.groupBy(*by).agg(
        F.count("*").alias("total_queries"), F.coalesce(F.avg("top_score"), zero).alias("avg_top_score"), F.coalesce(F.avg("avg_score"), zero).alias("avg_retrieval_score"),
        F.coalesce(F.avg((F.col("top_score") >= threshold).cast("double")), zero).alias("hit_rate"),
    )


def rounded(metrics: DataFrame, digits: int = 4) -> DataFrame:
    names = ("avg_top_score", "avg_retrieval_score", "hit_rate")
    return metrics.withColumns({n: F.round(n, digits) for n in names if n in metrics.columns})


def batch_document(results: DataFrame, threshold: float = THRESHOLD, order: str = "query_id") -> DataFrame:
    """One row `json`: the metrics and a list of the queries, as one export. It holds
    every query of the batch, as its purpose is."""
    item = F.struct(order, F.struct("query", F.round("top_score", 4).alias("top_score"), F.round("avg_score", 4).alias("avg_score"), "chunks_count").alias("q"))
    listed = results.agg(F.array_sort(F.collect_list(item)).alias("l")).select(F.transform("l", lambda x: x["q"]).alias("queries"))
    both = rounded(batch_metrics(results, threshold)).crossJoin(listed)
    return both.select(F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), *both.columns)).alias("json"))


def report(results: DataFrame, order: str = "query_id", first: int = 10) -> DataFrame:
    """(position, status, query, top_score, avg_score, best_match) of the first queries.
    The status of the report asks for more than the threshold, the metric for as much."""
    best = F.regexp_replace(F.substring(F.get("matches", 0)["text"], 1, 60), "\n", " ")
    head = results.orderBy(order).limit(first)
    position = F.row_number().over(Window.orderBy(order))
    return head.select(position.alias("position"), F.when(F.col("top_score") > THRESHOLD, "hit").otherwise("miss").alias("status"), F.substring("query", 1, 40).alias("query"), "top_score", "avg_score", best.alias("best_match"))


def grade(hit_rate: Column) -> Column:
    """Above 80 %, 60 to 80 %, below 60 %."""
    return F.when(hit_rate > 0.8, "good").when(hit_rate >= 0.6, "fair").otherwise("poor")
