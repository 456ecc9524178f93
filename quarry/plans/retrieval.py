"""Whole plans: documents to hits and prompts, and sweeps over parameters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import chunkers, clean, diagnostics, embed, evaluate, prompt, search

from .config import ChunkConfig


def chunk_id(doc: str = "doc_id", index: str = "chunk_index"):
    """One number a chunk, in the order of documents and chunks: 2^24 chunks a document,
    ids below 2^39. Anything beyond is an error, not another chunk's number."""
    d, i = F.col(doc).cast("long"), F.col(index)
    within = (F.abs(d) < 1 << 39) & (i < 1 << 24)
    return F.when(within | d.isNull(), d * (1 << 24) + i).otherwise(F.raise_error(F.lit("chunk_id: an id of 2^39 or more, or 2^24 chunks of one document")))


def index_documents(docs: DataFrame, config: ChunkConfig | None = None, quick_clean: bool = False, embedder=None, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunks with ids and vectors, as one lazy plan without a shuffle."""
    config = config or ChunkConfig()
    text = "text"
    if quick_clean:
        docs, text = clean.quick_clean(docs), "cleaned"
    chunks = chunkers.chunk(docs, config.strategy, config.chunk_size, config.overlap_tokens, text_col=text, id_cols=id_cols)
    return embed.embed(chunks.withColumn("chunk_id", chunk_id()), embedder)


def search_text(queries: DataFrame, chunks: DataFrame, k: int = search.TOP_K, embedder=None, query_col: str = "query", digits: int | None = None) -> DataFrame:
    """Hits with texts for (query_id, query) rows over indexed chunks."""
    probes = embed.embed(queries, embedder, query_col, "query_embedding")
    hits = search.top_k(probes, chunks, k, digits=digits, carry="text")
    return hits.select("query_id", "rank", "chunk_id", "text", "similarity")


def prompts(queries: DataFrame, hits: DataFrame, numbered: bool = False) -> DataFrame:
    """(query_id, query, prompt) from the best three hits of each query."""
    both = queries.join(prompt.contexts(hits, most=search.PROMPT_K), "query_id", "left")
    chunks = F.coalesce("chunks", F.array().cast("array<string>"))
    build = prompt.numbered_prompt if numbered else prompt.provider_prompt
    return both.select("query_id", "query", build(F.col("query"), chunks).alias("prompt"))


def answers(queries: DataFrame, chunks: DataFrame, generate, k: int = search.TOP_K, embedder=None, numbered: bool = False, digits: int | None = None) -> DataFrame:
    """(query_id, query, prompt, answer): search, the best three, the prompt and the answer of
    `generate`, a column function such as prompt.generate_udf() makes; a failure's
    text is the answer's end."""
    asked = prompts(queries, search_text(queries, chunks, k, embedder, digits=digits), numbered)
    return asked.withColumn("answer", generate(F.col("prompt")))


def sweep_chunks(docs: DataFrame, configs: Iterable[ChunkConfig], id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunks of all documents under every configuration, with its number, strategy,
    size and overlap; a branch of the plan for each, so every fold has constant sizes."""
    parts = []
    for i, c in enumerate(configs):
        chunks = chunkers.chunk(docs, c.strategy, c.chunk_size, c.overlap_tokens, id_cols=id_cols)
        labels = (("config_id", i), ("strategy", c.strategy), ("chunk_size", c.chunk_size), ("overlap_tokens", c.overlap_tokens))
        parts.append(chunks.select(*(F.lit(v).alias(k) for k, v in labels), *chunks.columns))
    return reduce(DataFrame.unionByName, parts)


def sweep_stats(docs: DataFrame, configs: Iterable[ChunkConfig]) -> DataFrame:
    return diagnostics.chunk_stats(sweep_chunks(docs, configs), ("config_id", "strategy", "chunk_size", "overlap_tokens"))


def sweep_rollup(docs: DataFrame, configs: Iterable[ChunkConfig]) -> DataFrame:
    """Chunks and characters by strategy and size, by strategy, and in all."""
    chunks = sweep_chunks(docs, configs)
    return chunks.rollup("strategy", "chunk_size").agg(F.count("*").alias("total_chunks"), F.sum(F.length("text")).cast("long").alias("total_characters"))


def sweep_hit_rates(docs: DataFrame, queries: DataFrame, configs: list[ChunkConfig], k: int = search.TOP_K, embedder=None, threshold: float = evaluate.THRESHOLD) -> DataFrame:
    """Metrics of every configuration, best hit rate first, with a grade."""
    parts = []
    for i, c in enumerate(configs):
        hits = search_text(queries, index_documents(docs, c, embedder=embedder), k, embedder)
        metrics = evaluate.batch_metrics(evaluate.per_query(queries, hits), threshold)
        parts.append(metrics.select(F.lit(i).alias("config_id"), F.lit(c.strategy).alias("strategy"), F.lit(c.chunk_size).alias("chunk_size"), F.lit(c.overlap_tokens).alias("overlap_tokens"), *metrics.columns))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("grade", evaluate.grade(F.col("hit_rate"))).orderBy(F.desc("hit_rate"), "config_id")
