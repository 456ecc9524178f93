"""All queries over the engine's own operators, with the SQL they are held to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import oracles_more, registry_more
from quarry.operators import chunkers, clean, diagnostics, embed, evaluate, prompt, search
from quarry.oracles import DIRTY
from quarry.oracles import ORACLES as OWN_ORACLES
from quarry.plans import config, retrieval
from quarry.plans.config import ChunkConfig
from quarry.sources import files, presets

Query = Callable[[SparkSession, str], DataFrame]
SWEEP = [ChunkConfig("fixed_chars", 100, 10, 10), ChunkConfig("fixed_chars", 200, 10, 20), ChunkConfig("token", 100, 10, 10), ChunkConfig("sentence", 100, 0, 0)]


def _table(name: str) -> Query:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, embeddings, benchmark, conversations = (_table(n) for n in ("documents", "pages", "embeddings", "benchmark", "conversations"))


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def _chunks(strategy: str, size: int, overlap: int, units: bool = True, source: Query = documents) -> Query:
    columns = ["doc_id", "chunk_index", "text", "start_pos", "end_pos"] + ["unit_count"] * units
    return lambda spark, sf_dir: chunkers.chunk(source(spark, sf_dir), strategy, size, overlap).select(*columns)


def by_headings(text: str, size: int, overlap: int):
    """A chunker as users write them: a chunk a heading."""
    at = 0
    for part in text.split("\n# "):
        yield part, at, at + len(part)
        at += len(part) + 3


def _custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n# ")))
    return chunkers.chunk(docs, "custom", function=by_headings).select("doc_id", "chunk_index", "text", "start_pos", "end_pos")


def _stats(chunks: DataFrame, *keys: str) -> DataFrame:
    return diagnostics.chunk_stats(chunks, keys).withColumn("avg_chunk_size", F.round("avg_chunk_size", 4))


def _cleaned(*steps: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        dirty = documents(spark, sf_dir).select("doc_id", F.expr(DIRTY).alias("text"))
        if not steps:
            return clean.quick_clean(dirty).select("doc_id", "cleaned", "removed_chars")
        done = dirty.withColumn("cleaned", clean.clean_column(F.col("text"), steps))
        return done.select("doc_id", "cleaned", (F.length("text") - F.length("cleaned")).alias("removed_chars"))

    return query


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries: every vector whose id is divisible by 20."""
    rows = embeddings(spark, sf_dir).filter("vec_id % 20 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("query"), F.col("embedding").alias("query_embedding"), "label")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_probes(spark, sf_dir), _vectors(spark, sf_dir), digits=5)


def _text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    return _hits(spark, sf_dir).join(texts, "chunk_id", "left").fillna({"text": ""})


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.per_query(_probes(spark, sf_dir).select("query_id", "query"), _text_hits(spark, sf_dir))
    return found.withColumn("avg_score", F.round("avg_score", 4))


def _search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.index_documents(documents(spark, sf_dir), ChunkConfig("sentence", 100, 0, 0))
    queries = benchmark(spark, sf_dir).filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.search_text(queries, index, digits=5)


def _prompts(numbered: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return retrieval.prompts(_probes(spark, sf_dir).select("query_id", "query"), _text_hits(spark, sf_dir), numbered).select("query_id", "prompt")

    return query


def _embed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embed.embed_distinct(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.size("embedding").alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prompt.chat_history(conversations(spark, sf_dir))
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return rows.select("conv_id", F.size("messages").alias("messages"), F.array_join(lines, "\n").alias("history"))


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = config.grid(spark).withColumn("strategy", F.lit("token"))
    return grid.select("chunk_size", "overlap_percent", *(config.export_column(f).alias(f) for f in ("json", "langchain", "llamaindex")))


def _presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(p[0]) for p in presets.BUILT_IN))
    return presets.list_presets(spark).select((F.array_position(names, F.col("name")) - 1).cast("int").alias("position"), "strategy", "chunk_size", "overlap_percent")


QUERIES: dict[str, Query] = {
    "chunk_fixed": _chunks("fixed_chars", 200, 20, False),
    "chunk_fixed_no_overlap": _chunks("fixed_chars", 100, 0, False),
    "chunk_token": _chunks("token", 100, 10),
    "chunk_sentence": _chunks("sentence", 100, 0),
    "chunk_sentence_overlap": _chunks("sentence", 100, 50),
    "chunk_paragraph": _chunks("paragraph", 200, 0, source=_doubled),
    "chunk_paragraph_overlap": _chunks("paragraph", 200, 100, source=_doubled),
    "chunk_recursive": _chunks("recursive", 200, 20, False),
    "chunk_custom_headers": _custom,
    "chunk_stats": lambda s, d: _stats(_chunks("fixed_chars", 200, 20)(s, d), "doc_id"),
    "chunk_stats_by_lang": lambda s, d: _stats(chunkers.chunk(documents(s, d), "fixed_chars", 200, 20, id_cols=("doc_id", "lang")), "lang"),
    "chunk_overlap_next": lambda s, d: diagnostics.with_overlap(chunkers.chunk(documents(s, d), "fixed_chars", 200, 20)).select("doc_id", "chunk_index", "token_estimate", "overlap_text", "overlap_chars", "links_next"),
    "chunk_quality": lambda s, d: diagnostics.with_quality(chunkers.chunk(documents(s, d), "sentence", 100, 0)).select("doc_id", "chunk_index", "ending", "length_flag", "starts_lower", "indicators", "palette"),
    "recommend_params": lambda s, d: documents(s, d).select("doc_id", diagnostics.recommend(F.col("text")).alias("r")).select("doc_id", "r.*"),
    "clean_newlines": _cleaned("newlines", "newline_runs", "line_ends"),
    "clean_spaces": _cleaned("spaces"),
    "clean_artifacts": _cleaned("page_lines", "rules"),
    "quick_clean": _cleaned(),
    "file_info": lambda s, d: pages(s, d).select("page_id", F.octet_length("html").cast("long").alias("size_bytes"), files.line_count(F.col("html")).alias("line_count"), F.length("html").alias("char_count")),
    "file_preview": lambda s, d: documents(s, d).select("doc_id", diagnostics.file_preview(F.col("text"), 3).alias("preview")),
    "format_size": lambda s, d: s.range(45).select(F.col("id").cast("int").alias("k"), diagnostics.format_file_size(F.pow(F.lit(2.0), F.col("id"))).alias("size")),
    "query_list_parse": lambda s, d: files.parse_queries(pages(s, d).select("page_id", F.replace("html", F.lit(">"), F.lit(">\n")).alias("text"))),
    "vector_topk": _hits,
    "vector_topk_same_label": lambda s, d: search.top_k_columns(_probes(s, d), _vectors(s, d), on=("label",)),
    "similarity_band": lambda s, d: search.result_cards(_hits(s, d).withColumn("text", F.lit(""))).drop("text", "preview"),
    "result_card": lambda s, d: search.result_cards(_text_hits(s, d)).select("query_id", "rank", "chunk_id", "band", "preview"),
    "batch_per_query": lambda s, d: _results(s, d).select("query_id", "top_score", "avg_score", "chunks_count"),
    "batch_metrics": lambda s, d: evaluate.rounded(evaluate.batch_metrics(_results(s, d))),
    "batch_report": lambda s, d: evaluate.report(_results(s, d)),
    "search_text": _search_text,
    "embed_dedupe": _embed_dedupe,
    "prompt_build": _prompts(False),
    "prompt_numbered": _prompts(True),
    "chat_history": _chat,
    "config_export": _export,
    "overlap_tokens_grid": lambda s, d: config.grid(s),
    "preset_list": _presets,
    "sweep_stats": lambda s, d: retrieval.sweep_stats(documents(s, d), SWEEP).withColumn("avg_chunk_size", F.round("avg_chunk_size", 4)),
    "sweep_rollup": lambda s, d: retrieval.sweep_rollup(documents(s, d), SWEEP),
}

QUERIES |= registry_more.QUERIES
ORACLES: dict[str, str] = OWN_ORACLES | oracles_more.ORACLES
