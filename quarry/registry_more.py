"""Queries over sources, sinks, services and streams, with the SQL they are held to in
`oracles_more.py`. Services answer through transports made here; files, presets, index
tables and streams are written below the folder that driver and executors share."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import streams
from quarry.functions.shared import shared_path
from quarry.operators import chunkers, clean, diagnostics, embed, evaluate, prompt, search
from quarry.plans import config, retrieval
from quarry.plans.config import ChunkConfig
from quarry.sources import files, index, presets, providers
from quarry.sources.providers import ProviderType
from quarry.streaming import chunks as streaming

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- files ---------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of seven kinds; every third is not UTF-8, and Windows' line ends are mixed in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = F.array(*map(F.lit, (".txt", ".MD", ".py", ".exe", ".json", "", ".pdf")))
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    odd = (F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 7 != 6)
    content = F.when(odd, F.concat(text.cast("binary"), F.unhex(F.lit("E9")))).otherwise(text.cast("binary"))
    path = F.concat(F.lit("/in.put/d"), F.col("doc_id").cast("string"), F.element_at(kinds, (F.col("doc_id") % 7 + 1).cast("int")))
    return docs.select(path.alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"))


def pages_by_line(content: bytes) -> list[str]:
    """An extractor for files whose pages are lines."""
    return content.decode("utf-8").replace("\r", "").split("\n")


def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.describe_files(_files(spark, sf_dir), extract_pages=pages_by_line)
    text = F.when(F.col("encoding") == "utf-8", F.col("content"))
    return rows.select("path", "name", "extension", "size_bytes", "line_count", "char_count", "encoding", "page_count", F.md5(text).alias("text_md5"))


def read_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.describe_files(_files(spark, sf_dir), extract_pages=pages_by_line).filter("extension = '.pdf'")
    return rows.select("name", "page_count", "encoding", F.md5("content").alias("text_md5"))


def read_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as files of a folder, read back."""
    path = shared_path(spark, "files")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws("\n", "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    nations.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    read = files.read_files(spark, path)
    return read.select(F.regexp_extract("path", "n_nationkey=([0-9]+)/", 1).cast("int").alias("n_nationkey"), "content", "extension", "size_bytes", "line_count", "char_count", "encoding", "page_count")


def _raised(act: Callable[[], object]) -> str:
    try:
        act()
    except Exception as problem:  # the kind of the error is what is asked for
        return type(problem).__name__
    return "none"


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and by which error."""
    docs = files.sample_documents(spark)
    store = search.VectorStore(spark, 2)
    cases = {
        "missing file": lambda: files.read_files(spark, f"{sf_dir}/none.txt"),
        "unknown strategy": lambda: chunkers.get_strategy("none"),
        "overlap as large as the size": lambda: chunkers.chunk(docs, "fixed", 10, 10),
        "custom without a function": lambda: chunkers.chunk(docs, "custom"),
        "unknown export": lambda: config.export_config(ChunkConfig(), "yaml"),
        "fewer vectors than texts": lambda: store.add_chunks(["a"], []),
        "vector of another width": lambda: store.add_chunks(["a"], [[1.0]]),
        "service without embeddings": lambda: providers.Client(ProviderType.GROQ, _service).embed("a"),
        "status 404": lambda: providers.Client(ProviderType.OPENAI, lambda *_: (404, b"")).generate("a"),
        "unknown file type": lambda: files.describe_files(_files(spark, sf_dir), strict=True, extract_pages=pages_by_line).agg(F.sum("size_bytes")).collect(),
        "too many chunks of a document": lambda: spark.range(1).select(F.lit(1 << 40).alias("doc_id"), F.lit(0).alias("chunk_index")).select(retrieval.chunk_id()).collect(),
    }
    return spark.createDataFrame([(k, _raised(act).replace("SparkRuntimeException", "error of a row").replace("PySparkRuntimeError", "error of a row")) for k, act in cases.items()], "refused string, error string")


# -- presets and settings ---------------------------------------------------------------


def _saved(spark: SparkSession) -> str:
    path = shared_path(spark, "presets")
    for name, size in (("My preset!", 321), ("My preset?", 322), ("gone", 9), ("📚 Long Documents", 7), ("Über-1", 444)):
        presets.save_preset(spark, path, name, "sentence", size, 12, "of my own", "2020-01-01T00:00:00")
    presets.delete_preset(spark, path, "gone")
    return path


def preset_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = presets.list_presets(spark, _saved(spark))
    return rows.filter("not built_in").select("name", "strategy", "chunk_size", "overlap_percent", "description", "created_at")


def preset_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _saved(spark)
    found = [(asked, presets.load_preset(spark, asked, path)) for asked in ("📚 LONG documents", "My preset!", "Über-1", "gone", "nothing")]
    return spark.createDataFrame([(asked, p["strategy"], p["chunk_size"], p["overlap_percent"]) if p else (asked, None, None, None) for asked, p in found], "asked string, strategy string, chunk_size int, overlap_percent int")


def preset_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _saved(spark)
    return spark.createDataFrame([(n, presets.delete_preset(spark, path, n)) for n in ("Über-1", "Über-1", "📚 Long Documents", "none")], "name string, deleted boolean").groupBy("name").agg(F.sum(F.col("deleted").cast("int")).cast("int").alias("times"))


def config_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three exports of settings that are read from a dictionary with defaults."""
    rows = [(i, form, config.export_config(ChunkConfig.from_dict(d), form)) for i, d in enumerate(({}, {"chunk_size": 300, "other": 1}, {"strategy": "sentence", "overlap_tokens": 7})) for form in ("json", "langchain", "llamaindex")]
    return spark.createDataFrame(rows, "i int, form string, export string")


def config_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from JSON that lacks one key or the other."""
    part = F.when(F.col("chunk_size") % 100 == 0, F.to_json(F.struct("chunk_size", "overlap_percent"))).otherwise(F.to_json(F.struct("overlap_tokens", F.lit("sentence").alias("strategy"))))
    return config.grid(spark).select("chunk_size", "overlap_percent", config.from_json_column(part).alias("c")).select(F.col("chunk_size").alias("size_0"), F.col("overlap_percent").alias("percent_0"), "c.*")


def clamped_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(-100, 1301, 25).select(F.col("id").cast("int").alias("asked"), config.clamp_size(F.col("id").cast("int")).alias("chunk_size"), config.clamp_percent(F.col("id").cast("int")).alias("overlap_percent"))


def strategy_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.strategies(spark).filter(F.col("name").isin([s.value for s in chunkers.Strategy])).select("type", "name", (F.length("description") > 0).alias("described"))


# -- chunking and diagnostics --------------------------------------------------------------


def by_lines(text, size: int, overlap: int):
    """A strategy as users register them: a chunk a line."""
    lines = F.split(text, "\n", -1)
    joined = lambda i: F.array_join(F.slice(lines, F.lit(1), i), "\n")

    def line(x, i):
        start = F.when(i == 0, 0).otherwise(F.length(joined(i)) + 1)
        return F.struct(x.alias("text"), start.cast("int").alias("start_pos"), (start + F.length(x)).cast("int").alias("end_pos"), F.lit(1).alias("unit_count"))

    return F.transform(lines, line)


def chunk_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunkers.register("lines", by_lines, "line", "A chunk a line")
    rows = chunkers.chunk(table(spark, sf_dir, "documents"), "lines")
    return rows.select("doc_id", "chunk_index", "text", "start_pos", "end_pos", "unit_kind", "unit_count")


def chunk_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.chunk(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "text", "unit_kind", "unit_count")


def clean_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    def clean_digits(text: str) -> str:
        if text.startswith("T"):
            raise ValueError("a failure keeps the text")
        return "".join("0" if "1" <= c <= "9" else c for c in text)

    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean.quick_clean(rows, cleaner=clean_digits).select("doc_id", F.md5("cleaned").alias("cleaned_md5"), "removed_chars")


def stats_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents, of which some are blank."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("text")))
    stats = diagnostics.chunk_stats(chunkers.chunk(docs, "fixed_chars", 200, 20), ("doc_id",), docs)
    return stats.select("doc_id", "total_chunks", "total_characters", F.round("avg_chunk_size", 4).alias("avg_chunk_size"), "min_chunk_size", "max_chunk_size", "total_tokens_est")


def chunk_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnostics.with_overlap(chunkers.chunk(table(spark, sf_dir, "documents"), "fixed_chars", 200, 20))
    return diagnostics.with_highlight(rows).select("doc_id", "chunk_index", "before", "overlap")


def summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = diagnostics.chunk_stats(chunkers.chunk(table(spark, sf_dir, "documents"), "fixed_chars", 200, 20))
    return diagnostics.summary_line(stats).select("doc_id", "summary")


def sample_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunkers.chunk(files.sample_documents(spark), "paragraph", 30, 0)
    return rows.select("doc_id", "chunk_index", F.length("text").alias("characters"), "unit_count")


# -- embedding and search -----------------------------------------------------------------


def letters(text: str) -> list[float]:
    """The vector that the service below has for a text."""
    return [float(len(text)), float(text.count("e")), float(text.count("a")), 1.0]


def _service(method: str, url: str, headers: dict, body: bytes | None, timeout: float) -> tuple[int, bytes]:
    """A service for all kinds of clients; it answers a prompt by its length, and fails at the word vector 40."""
    if body is None:
        return (200, b"{}") if "openai" in url or "localhost" in url else (503, b"")
    asked = json.loads(body)
    if "input" in asked:
        found: dict = {"data": [{"index": i, "embedding": letters(t)} for i, t in reversed(list(enumerate(asked["input"])))]}
    elif "prompt" in asked and "stream" not in asked:
        found = {"embedding": letters(asked["prompt"])}
    else:
        text = asked.get("prompt") or asked["messages"][-1]["content"]
        if "vector 40\n" in text:
            return 500, b""
        words = ["It", " has", f" {len(text)}", " characters"]
        if asked.get("stream") and "messages" in asked:
            return 200, "".join("data: " + json.dumps({"choices": [{"delta": {"content": w}}]}) + "\n\n" for w in words).encode() + b"data: [DONE]\n"
        if asked.get("stream"):
            return 200, "".join(json.dumps({"response": w}) + "\n" for w in words).encode()
        found = {"response": "".join(words), "choices": [{"message": {"content": "".join(words)}}]}
    return 200, json.dumps(found).encode()


class Failing:
    """The service, which fails at every text's first `times` requests."""

    def __init__(self, times: int):
        self.times, self.seen = times, {}

    def __call__(self, method: str, url: str, headers: dict, body: bytes | None, timeout: float) -> tuple[int, bytes]:
        self.seen[body] = self.seen.get(body, 0) + 1
        return (500, b"") if self.seen[body] <= self.times else _service(method, url, headers, body, timeout)


def _four(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *(F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(4)))


def embed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _four(embed.embed(docs, providers.remote_embedder(ProviderType.OPENAI, _service)))


def embed_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests at a time; every text's first two fail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text"])
    out = embed.embed(docs, providers.bounded_embedder(ProviderType.OPENAI, Failing(2), sleep=lambda s: None))
    return out.agg(F.count("*").alias("texts"), F.sum(F.get("embedding", 0)).cast("long").alias("characters"), F.sum(F.get("embedding", 3)).cast("long").alias("ones"))


def embed_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and pauses of a call that fails a number of times in one way or another."""
    rows = []
    for name, problem in (("status 500", providers.HTTPError(500)), ("time-out", TimeoutError()), ("status 404", providers.HTTPError(404)), ("unforeseen", KeyError())):
        for times in range(7):
            tried, pauses = [], []

            def call(tried=tried, times=times, problem=problem):
                tried.append(1)
                if len(tried) <= times:
                    raise problem
                return "answer"

            error = _raised(lambda call=call, pauses=pauses: providers.retried(call, sleep=pauses.append))
            rows.append((name, times, len(tried), float(sum(pauses)), error == "none"))
    return spark.createDataFrame(rows, "problem string, failures int, attempts int, paused double, answered boolean")


def embedding_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("embedding")
    mixed = rows.unionByName(spark.createDataFrame([([1.0],)], rows.schema))
    return spark.createDataFrame([(embed.check_dimensions(rows), _raised(lambda: embed.check_dimensions(mixed)))], "width int, mixed string")


def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of three: what is left after each text, and whether the first is still known."""
    cache, rows = embed.EmbeddingCache(3), []
    for i, text in enumerate("abcadeab"):
        known = cache.get(text) is not None
        cache.put(text, [float(i)])
        rows.append((i, text, known, len(cache)))
    return spark.createDataFrame(rows, "i int, text string, known boolean, kept int")


def index_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations are indexed, one of them anew: its chunks are replaced."""
    docs, path = table(spark, sf_dir, "documents"), shared_path(spark, "index")
    one = lambda text: F.array(F.length(text).cast("float"))
    index.write_index(docs, path, 0, ChunkConfig("fixed_chars", 200, 10, 20), one)
    index.write_index(docs, path, 1, ChunkConfig("fixed_chars", 100, 0, 0), one)
    index.write_index(docs, path, 1, ChunkConfig("token", 100, 10, 10), one)
    rows = index.read_index(spark, path)
    return rows.groupBy("config_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).cast("long").alias("characters"))


def _store(spark: SparkSession, sf_dir: str) -> search.VectorStore:
    rows = table(spark, sf_dir, "embeddings")
    width = rows.select(F.max(F.size("embedding"))).first()[0]
    store = search.VectorStore(spark, width)
    store.add_chunks(["first", "second"], [[1.0] + [0.0] * (width - 1), [0.0] * (width - 1) + [1.0]], [{"chunk_id": "own", "page": 3}, {}])
    chunks = rows.select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3).cast("int").alias("chunk_index"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"), "embedding")
    store.add_frame(chunks)
    return store


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).frame().select("chunk_id", "chunk_index", "text", F.col("metadata")["chunk_id"].alias("own_id"), F.col("metadata")["page"].alias("page"))


def vector_store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    before = store.stats()
    hits = store.search([1.0] + [0.0] * (store.dimensions - 1)).count()
    store.clear()
    return spark.createDataFrame([(before["chunks"], before["dimensions"], before["vector_bytes"], hits, store.count())], "chunks long, dimensions int, vector_bytes long, hits long, after_clear long")


def approximate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the exact five nearest of every stated query, the share that the approximate
    search finds over all rows: at least 0.9. Similarities are rounded, so that both
    searches order equal vectors by id."""
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    exact = search.top_k(queries, vectors, digits=9).select("query_id", "chunk_id")
    found = search.approximate_top_k(queries, vectors, digits=9).select("query_id", "chunk_id", F.lit(1).alias("found"))
    both = exact.join(found, ["query_id", "chunk_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.count("found") >= 0.9 * F.count("*")).alias("recall_reached"))


# -- evaluation and answers ------------------------------------------------------------------


def batch_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry import registry

    rows = evaluate.per_query(registry._probes(spark, sf_dir).select("query_id", "query"), registry._text_hits(spark, sf_dir))
    return rows.select("query_id", F.posexplode("matches").alias("pos", "m")).select("query_id", "pos", "m.text", "m.score")


def batch_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry import registry

    out = evaluate.batch_document(registry._results(spark, sf_dir))
    schema = "timestamp string, total_queries long, avg_top_score double, avg_retrieval_score double, hit_rate double, queries array<struct<query:string,top_score:double,avg_score:double,chunks_count:int>>"
    rows = out.select(F.from_json("json", schema).alias("j")).select("j.*").filter(F.to_timestamp("timestamp").isNotNull())
    return rows.select("total_queries", "avg_top_score", "avg_retrieval_score", "hit_rate", F.explode("queries").alias("q")).select("total_queries", "avg_top_score", "avg_retrieval_score", "hit_rate", "q.*")


def hit_rate_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(101).select(F.col("id").cast("int").alias("percent"), evaluate.grade(F.col("id") / 100).alias("grade"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


SWEPT = [ChunkConfig("sentence", 100, 0, 0), ChunkConfig("fixed_chars", 100, 10, 10)]


def sweep_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.sweep_hit_rates(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), SWEPT)
    return evaluate.rounded(rows, 3).select("config_id", "strategy", "chunk_size", "overlap_tokens", "total_queries", "avg_top_score", "hit_rate", "grade")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("query"), F.col("embedding").alias("query_embedding"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return queries, rows.select(F.col("vec_id").alias("chunk_id"), "embedding").join(texts, "chunk_id", "left").fillna({"text": ""})


def rag_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, prompt and answer as one plan. The queries have their vectors as texts' do:
    by a function of the text."""
    queries, chunks = _asked(spark, sf_dir)
    vectors = {r.query: r.query_embedding for r in queries.collect()}  # the stated queries' own
    embedder = embed.embedder_udf(lambda: lambda texts: [vectors[t] for t in texts])
    found = retrieval.answers(queries.select("query_id", "query"), chunks, providers.remote_generator(ProviderType.OPENAI, _service), embedder=embedder, digits=5)
    return found.select("query_id", "answer")


def generate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return turns.select("conv_id", "turn", providers.remote_generator(ProviderType.OLLAMA, _service)("text").alias("answer"))


def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of two kinds of streams, made of each turn's words, and the texts in them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), " ", -1).alias("w"))
    pieces = F.transform("w", lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(" "), x)))
    ndjson = F.array_join(F.transform(pieces, lambda p: F.to_json(F.struct(p.alias("response")))), "\n")
    event = lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(p.alias("content")).alias("delta"))).alias("choices"))))
    sse = F.concat(F.array_join(F.transform(pieces, event), "\r\n\r\n"), F.lit("\n: ping\ndata: {broken\ndata: [DONE]\n"))
    return turns.select("conv_id", "turn", streams.answer(streams.ndjson_pieces(ndjson)).alias("ndjson"), streams.answer(streams.sse_pieces(sse)).alias("sse"))


def client_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for kind in (ProviderType.OLLAMA, ProviderType.OPENAI, ProviderType.GROQ):
        client = providers.Client(kind, _service)
        pieces = list(client.stream_generate("how long"))
        rows.append((kind.value, len(pieces), "".join(pieces), client.chat([{"role": "user", "content": "how long"}]) if kind is not ProviderType.OLLAMA else client.generate("how long")))
    return spark.createDataFrame(rows, "kind string, pieces int, streamed string, whole string")


def provider_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = [kind for kind in providers.PROVIDERS if providers.Client(kind, _service).config.key_variable is None and providers.Client(kind, _service).check()]
    first = providers.best(lambda method, url, *rest: (200, b"{}") if "localhost" in url else (503, b""))
    rows = providers.providers(spark).select("type", "embedding_dim", "supports_embedding", "supports_llm")
    return rows.withColumn("answers", F.col("type").isin([k.value for k in up])).withColumn("best", F.col("type") == first[0].value)


# -- streams -----------------------------------------------------------------------------------


def stream_newest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every document arrive; the chunks of the newer ones are left."""
    path = shared_path(spark, "stream")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.withColumn("version", F.lit(1).cast("long")).withColumn("text", F.lit("replaced"))
    old.unionByName(docs.withColumn("version", F.lit(2).cast("long"))).write.parquet(f"{path}/in")
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    arriving = streaming.document_stream(spark, f"{path}/in", files_per_batch=1_000_000)
    streaming.write_newest_chunks(arriving, write, f"{path}/state", available_now=True, strategy="fixed_chars", chunk_size=200, overlap=20).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "version", "chunk_index", "start_pos", "end_pos")


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of arriving documents in append mode, without state."""
    path = shared_path(spark, "stream")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.parquet(f"{path}/in")
    docs = streaming.document_stream(spark, f"{path}/in", "doc_id long, text string")
    chunks = streaming.chunk_stream(docs, "fixed_chars", 200, 20).select("doc_id", "chunk_index", "start_pos", "end_pos")
    chunks.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        read_files, read_pdf, read_folder, errors, preset_saved, preset_load, preset_delete, config_forms, config_from_json, clamped_params, strategy_catalogue,
        chunk_registered, chunk_defaults, clean_custom, stats_with_empty, chunk_highlight, summary_line, sample_text,
        embed_batch, embed_in_flight, embed_retry, embedding_width, embedding_cache, index_rewrite, vector_store, vector_store_stats, approximate_recall,
        batch_matches, batch_document, hit_rate_grade, sweep_hit_rates, rag_answers, generate_answers, streamed_answers, client_streams, provider_catalogue,
        stream_newest_chunks, stream_chunks,
    )
}
