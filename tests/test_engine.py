"""Cleaning, diagnostics, files, presets, exports, embedding, search, evaluation,
prompts, providers and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import registry
from quarry.functions import text as fn
from quarry.operators import chunkers, clean, diagnostics, embed, evaluate, prompt, search
from quarry.plans import config, retrieval
from quarry.plans.config import ChunkConfig
from quarry.sources import files, presets, providers
from quarry.streaming import chunks as streaming

SPACES = [c for c in map(chr, range(0x10000)) if c.isspace()]


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_white_space_is_pythons(spark):
    texts = [c + "a b" + c for c in SPACES] + [chr(0x200B) + "a", "", " \n", None]
    assert column(spark, texts, fn.strip) == [t.strip() if t is not None else None for t in texts]
    assert column(spark, texts, fn.is_blank) == [not (t or "").strip() for t in texts]


def test_find(spark):
    cases = [("abcabc", "bc", 0), ("abcabc", "bc", 2), ("abc", "x", 0), ("abc", "", 2), ("abc", "", 3), ("abc", "c", 9)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, p string, s int").orderBy("i")
    assert [r[0] for r in df.select(fn.find(F.col("t"), F.col("p"), F.col("s"))).collect()] == [t.find(p, s) for t, p, s in cases]


def test_quick_clean(spark):
    texts = ["a\r\nb\rc", "a\n\n\n\n\nb", "x  \t y  \n z", "one\n  Page 12  \ntwo\n---\nthree", "  \n ", None, "a \n \n \n b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [(r.cleaned, r.removed_chars) for r in clean.quick_clean(df).orderBy("i").collect()]
    assert [g[0] for g in got] == ["a\nb\nc", "a\n\nb", "x y\n z", "one\n\ntwo\n\nthree", "  \n ", None, "a\n\n\n b"]
    assert got[0][1] == 1 and got[5][1] is None and got[4][1] == 0


def test_own_cleaner_keeps_failing_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None)], "i int, text string")

    def cleaner(text):
        if text == "bad":
            raise RuntimeError("no")
        return text.upper()

    assert [r.cleaned for r in clean.quick_clean(df, cleaner=cleaner).orderBy("i").collect()] == ["AB", "bad", None]


def test_diagnostics(spark):
    df = spark.createDataFrame([(1, "Done. "), (2, "so on;"), (3, "lower cut"), (4, ""), (5, "X" * 2404), (6, "Q?")], "doc_id long, text string").withColumn("chunk_index", F.col("doc_id").cast("int"))
    rows = diagnostics.with_quality(df).orderBy("doc_id").collect()
    assert [r.ending for r in rows] == ["complete", "midphrase", "cut", "cut", "cut", "complete"]
    assert [r.length_flag for r in rows] == ["SHORT"] * 4 + ["LONG", "SHORT"]
    assert rows[2].indicators == "cut SHORT CUT" and [r.palette for r in rows] == [1, 2, 3, 4, 5, 0]
    chunks = chunkers.chunk(df.filter("doc_id = 5"), "fixed", 100, 10)
    lapped = diagnostics.with_highlight(diagnostics.with_overlap(chunks)).orderBy("chunk_index").collect()
    assert [r.overlap_chars for r in lapped] == [40] * (len(lapped) - 1) + [0] and all(r.before + r.overlap == r.text for r in lapped)
    stats = diagnostics.chunk_stats(chunks, documents=df).orderBy("doc_id").collect()
    assert stats[0].total_chunks == 0 and stats[0].avg_chunk_size == 0 and stats[4].total_tokens_est == stats[4].total_characters // 4
    line = diagnostics.summary_line(diagnostics.chunk_stats(chunks)).first().summary
    assert line == "7 chunks, 378 characters on average, 2,644 in all, about 661 tokens"


def test_recommendations_and_previews(spark):
    assert [r["size"] for r in column(spark, ["", "x" * 1999, "x" * 2000, "x" * 8000], diagnostics.recommend)] == [None, "100-150", "200-300", "300-500"]
    assert column(spark, ["a\nb", "a\nb\nc\nd"], lambda c: diagnostics.file_preview(c, 2)) == ["a\nb", "a\nb\n... (2 more lines)"]
    assert column(spark, [0, 1023, 1024, 1536, 5 * 1024**2, 3 * 1024**3, 2 * 1024**5], diagnostics.format_file_size, "long") == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB", "2048.0 TB"]


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("é\r\nb\rc".encode())
    (tmp_path / "b.md").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.py").write_text("x = 1")
    (tmp_path / "d.pdf").write_bytes(b"first|  |third")
    (tmp_path / "e.exe").write_bytes(b"no")
    read = files.read_files(spark, str(tmp_path), extract_pages=lambda data: ["" if not p.strip() else p for p in data.decode().split("|")])
    got = {r.name: r for r in read.collect()}
    assert set(got) == {"a.TXT", "b.md", "c.py", "d.pdf"}
    assert (got["a.TXT"].content, got["a.TXT"].line_count, got["a.TXT"].char_count, got["a.TXT"].size_bytes, got["a.TXT"].encoding, got["a.TXT"].extension) == ("é\nb\nc", 3, 5, 7, "utf-8", ".txt")
    assert (got["b.md"].content, got["b.md"].encoding) == ("é", "latin-1")
    assert (got["d.pdf"].content, got["d.pdf"].page_count, got["d.pdf"].encoding) == ("--- Page 1 ---\nfirst\n\n--- Page 3 ---\nthird", 3, "pdf")
    with pytest.raises(FileNotFoundError):
        files.read_files(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="unsupported file type"):
        files.read_files(spark, str(tmp_path / "e.exe"), strict=True).collect()
    assert len(files.EXTENSIONS) == 17 and files.sample_documents(spark).first().text.count("\n\n") == 4


def test_queries_are_parsed_in_order(spark):
    df = spark.createDataFrame([(1, " first \n\n \nsecond")], "k int, text string")
    assert [(r.pos, r["query"]) for r in files.parse_queries(df).orderBy("pos").collect()] == [(0, "first"), (3, "second")]


def test_presets(spark, tmp_path):
    path = str(tmp_path)
    assert presets.list_presets(spark, path).count() == 8
    presets.save_preset(spark, path, "My set/1", "fixed", 300, 10)
    presets.save_preset(spark, path, "📄 general text", "token", 1, 0)
    presets.save_preset(spark, path, "📄 General Text", "token", 2, 0)
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "pretty.json").write_text(json.dumps({"name": "Pretty", "strategy": "token", "chunk_size": 10, "overlap_percent": 5, "description": "", "created_at": ""}, indent=2))
    names = {r.name for r in presets.list_presets(spark, path).filter("not built_in").collect()}
    assert names == {"My set/1", "Pretty"}
    assert presets.load_preset(spark, "My set/1", path)["chunk_size"] == 300
    assert presets.load_preset(spark, "📄 GENERAL TEXT", path)["chunk_size"] == 256
    assert presets.load_preset(spark, "none", path) is None
    assert presets.delete_preset(spark, path, "My set/1") and not presets.delete_preset(spark, path, "My set/1")
    assert not presets.delete_preset(spark, path, "📄 General Text")
    assert chunkers.get_strategy("fixed").strategy is chunkers.Strategy.FIXED_CHARS


def test_exports(spark):
    c = ChunkConfig("token", 200, 10, 20)
    assert json.loads(config.export_config(c)) == c.to_dict() and list(c.to_dict()) == ["strategy", "chunk_size", "overlap_percent", "overlap_tokens"]
    assert "chunk_size=800" in config.export_config(c, "langchain") and "chunk_overlap=80" in config.export_config(c, "llamaindex")
    with pytest.raises(ValueError):
        config.export_config(c, "xml")
    assert ChunkConfig.from_dict({"chunk_size": 5}) == ChunkConfig("token", 5, 10, 20)
    row = spark.createDataFrame([(c.to_json(),), ("{}",)], "j string").select(config.from_json_column(F.col("j")).alias("c")).collect()
    assert [r.c.asDict() for r in row] == [c.to_dict(), ChunkConfig().to_dict()]
    differ = config.grid(spark).filter("overlap_tokens <> export_overlap_tokens").collect()
    assert [(r.chunk_size, r.overlap_percent) for r in differ] == [(700, 35)]


def test_search_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[7] = 0
    x[8] = x[9]
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "chunk_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(q, [float(v) for v in x[q]]) for q in (1, 7, 9)], "query_id long, query_embedding array<float>")
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    alike = search.top_k_columns(queries.withColumn("g", F.lit(1)), vectors.withColumn("g", F.lit(1)), ("g",), 4)
    for got in (search.top_k(queries, vectors, 4, digits=5), alike):
        rows = {(r.query_id, r.rank): (r.chunk_id, r.similarity) for r in got.collect()}
        for q in (1, 7, 9):
            sims = np.round(unit @ unit[q], 5) if q != 7 else np.zeros(300)
            best = sorted(range(300), key=lambda i: (-sims[i], i))[:4]
            assert [rows[q, k + 1][0] for k in range(4)] == best and all(abs(rows[q, k + 1][1] - sims[i]) < 1e-5 for k, i in enumerate(best))
    many = {(r.query_id, r.rank): r.chunk_id for r in search.top_k(queries, vectors, 4, digits=5).collect()}
    old, search.BROADCAST_VALUES = search.BROADCAST_VALUES, 16
    try:
        assert {(r.query_id, r.rank): r.chunk_id for r in search.top_k(queries, vectors, 4, digits=5).collect()} == many
    finally:
        search.BROADCAST_VALUES = old
    near = search.approximate_top_k(queries, vectors, 1, bucket=2.0, tables=16)
    assert {r.query_id: r.chunk_id for r in near.collect() if r.query_id != 7} == {1: 1, 9: 8}


def test_approximate_search_shuffles_no_vectors(spark):
    x = np.random.default_rng(3).standard_normal((400, 16)).astype(np.float32)
    x[300:] = x[200:300]  # copies: ties are settled by id
    x[5] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>")
    queries = vectors.filter("chunk_id % 20 = 0 or chunk_id = 5").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = search.approximate_top_k(queries, vectors, digits=9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 1  # the k best of each task alone
    rows = {(r.query_id, r.rank): (r.chunk_id, r.similarity) for r in found.collect()}
    exact = {(r.query_id, r.rank): (r.chunk_id, r.similarity) for r in search.top_k(queries, vectors, digits=9).collect()}
    assert sum(rows.get(k) == v for k, v in exact.items()) >= 0.9 * len(exact)
    assert all(s == 0 for (q, _), (_, s) in rows.items() if q == 5)  # 0.5 by distances
    old, search.CELLS = search.CELLS, 50
    try:  # few rows at a time
        assert {(r.query_id, r.rank): (r.chunk_id, r.similarity) for r in search.top_k(queries, vectors, digits=9).collect()} == exact
    finally:
        search.CELLS = old
    # narrow buckets: far fewer pairs, none of rows that share none
    few = search.approximate_top_k(queries, vectors, 400, bucket=0.02, tables=1)
    assert 0 < few.count() < 21 * 200


def test_vector_store(spark):
    store = search.VectorStore(spark, 2)
    assert store.search([1.0, 0.0]).count() == 0
    store.add_chunks(["a", "b"], [[1, 0], [0, 1]], [{"chunk_id": "x", "page": 3}, {}])
    store.add_chunks(["a"], [[-1, 0]])
    assert store.count() == 3 and [(r.chunk_id, r.text, round(r.similarity, 3)) for r in store.search([1.0, 0.0], 3).collect()] == [(0, "a", 1.0), (1, "b", 0.0), (2, "a", -1.0)]
    assert store.search([1.0, 0.0], 1).first().metadata == {"chunk_id": "0", "chunk_index": "0", "page": "3"}
    frame = spark.createDataFrame([(1, 0, "c", [0.0, 1.0])], "doc_id long, chunk_index int, text string, embedding array<float>")
    store.add_frame(frame)
    assert store.stats() == {"chunks": 4, "dimensions": 2, "vector_bytes": 32} and store.search([0.0, 1.0], 2).collect()[1].chunk_id == 3
    for bad in (lambda: store.add_chunks(["a"], []), lambda: store.add_chunks(["a"], [[1]])):
        with pytest.raises(ValueError):
            bad()
    store.clear()
    assert store.count() == 0


def test_cards(spark):
    df = spark.createDataFrame([(0, -0.2, "x" * 301), (1, 0.5, "y"), (2, 0.8, "z"), (3, 1.0, "")], "i int, similarity double, text string")
    rows = search.result_cards(df).orderBy("i").collect()
    assert [(r.filled, r.band) for r in rows] == [(0, "red"), (15, "yellow"), (24, "green"), (30, "green")]
    assert rows[0].preview == "x" * 300 + "..." and all(len(r.bar) == 30 for r in rows)


def test_batch_evaluation(spark):
    queries = spark.createDataFrame([(i, f"query {i}") for i in range(4)], "query_id int, query string")
    hits = spark.createDataFrame([(0, 1, "a\nb" + "x" * 200, 0.9), (0, 2, "c", 0.5), (1, 1, "d", 0.5), (2, 1, "e", 0.3)], "query_id int, rank int, text string, similarity double")
    results = evaluate.per_query(queries, hits)
    rows = {r.query_id: r for r in results.collect()}
    assert (rows[0].top_score, rows[0].avg_score, rows[0].chunks_count, len(rows[0].matches[0].text)) == (0.9, 0.7, 2, 100) and (rows[3].top_score, rows[3].chunks_count, rows[3].matches) == (0.0, 0, [])
    m = evaluate.batch_metrics(results).first()
    assert (m.total_queries, round(m.avg_top_score, 4), m.hit_rate) == (4, 0.425, 0.5)
    none = evaluate.batch_metrics(results.limit(0)).first()
    assert (none.total_queries, none.avg_top_score, none.hit_rate) == (0, 0.0, 0.0)
    assert [(r.position, r.status, r.best_match) for r in evaluate.report(results, first=2).collect()] == [(1, "hit", "a b" + "x" * 57), (2, "miss", "d")]
    told = json.loads(evaluate.batch_document(results).first().json)
    assert told["total_queries"] == 4 and [q["query"] for q in told["queries"]] == [f"query {i}" for i in range(4)]
    assert column(spark, [0.81, 0.8, 0.6, 0.59], evaluate.grade, "double") == ["good", "fair", "fair", "poor"]


def test_prompts(spark):
    hits = spark.createDataFrame([(1, r, f"t{r}") for r in (3, 1, 2, 4)], "query_id int, rank int, text string")
    queries = spark.createDataFrame([(1, "Why?"), (2, "How?")], "query_id int, query string")
    both = {r.query_id: r.prompt for r in retrieval.prompts(queries, hits).collect()}
    assert both[1].endswith("Context:\nt1\n\n---\n\nt2\n\n---\n\nt3\n\nQuestion: Why?\n\nAnswer:") and "t4" not in both[1] and "Question: How?" in both[2]
    numbered = retrieval.prompts(queries, hits, numbered=True).filter("query_id = 1").first().prompt
    assert "Context 1:\nt1\n\nContext 2:\nt2\n\nContext 3:\nt3\n\nQuestion: Why?" in numbered
    answers = queries.select(prompt.generate_udf(lambda: lambda p: p.upper() if p != "How?" else 1 / 0)(F.col("query")).alias("a")).collect()
    assert answers[0].a == "WHY?" and "Error: division by zero" in answers[1].a


def test_embedding_reuse(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], "doc_id long, text string")
    calls = spark.sparkContext.accumulator(0)

    def connect():
        def run(texts):
            calls.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return run

    udf = embed.embedder_udf(connect, 1)
    got = {r.doc_id: r.embedding for r in embed.embed_distinct(df, udf).collect()}
    assert got == {1: [3.0, 1.0], 2: [3.0, 1.0], 3: None, 4: [0.0, 1.0]} and calls.value == 2
    known = spark.createDataFrame([("a b", [9.0, 9.0])], "text string, embedding array<float>")
    assert {r.doc_id: r.embedding for r in embed.embed_distinct(df, udf, known=known).collect()}[1] == [9.0, 9.0] and calls.value == 3
    assert embed.check_dimensions(embed.embed(df.filter("text is not null"))) == 64
    with pytest.raises(ValueError):
        embed.check_dimensions(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>"))
    cache = embed.EmbeddingCache(2)
    for t in "ab":
        cache.put(t, [1.0])
    cache.get("a")
    cache.put("c", [2.0])
    assert cache.get("b") is None and cache.get("a") == [1.0] and len(cache) == 2
    cache.clear()
    assert len(cache) == 0


def test_search_text_end_to_end(spark):
    docs = spark.createDataFrame([(1, "Cats sleep all day. Dogs bark at night."), (2, "Rain falls in spring.")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "dogs bark"), (2, "spring rain falls")], "query_id int, query string")
    hits = retrieval.search_text(queries, retrieval.index_documents(docs, ChunkConfig("sentence", 6, 0, 0), quick_clean=True), 1)
    assert {r.query_id: r.text for r in hits.collect()} == {1: "Dogs bark at night.", 2: "Rain falls in spring."}
    swept = retrieval.sweep_hit_rates(docs, queries, [ChunkConfig("sentence", 6, 0, 0), ChunkConfig("fixed", 100, 0, 0)], threshold=0.6)
    assert swept.first().config_id == 0 and swept.count() == 2


class Fake:
    """A transport that fails as told, then answers."""

    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def __call__(self, method, url, headers, body, timeout):
        self.seen.append((method, url, json.loads(body) if body else None))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def ok(value):
    return 200, json.dumps(value).encode()


def test_providers(spark, monkeypatch):
    naps = []
    fake = Fake((500, b""), TimeoutError(), ok({"embedding": [1.0]}), ok({"embedding": [2.0]}))
    client = providers.Client(providers.ProviderType.OLLAMA, fake, sleep=naps.append)
    assert client.embed_batch(["a", "b"]) == [[1.0], [2.0]] and naps == [1, 2, 0.2]
    with pytest.raises(providers.HTTPError):
        providers.Client(providers.ProviderType.OLLAMA, Fake((404, b"")), sleep=naps.append).embed("a")
    with pytest.raises(KeyError):
        providers.retried(lambda: {}["x"], 3, naps.append)
    assert naps[-2:] == [1, 2]
    assert providers.Client(providers.ProviderType.OPENAI, Fake(ok({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}))).embed_batch(["a", "b"]) == [[1], [2]]
    with pytest.raises(NotImplementedError):
        providers.Client(providers.ProviderType.GROQ, Fake()).embed("a")
    assert providers.Client(providers.ProviderType.GROQ, Fake(ok({"choices": [{"message": {"content": "hi"}}]}))).generate("p") == "hi"
    assert providers.Client(providers.ProviderType.GOOGLE, Fake(ok({"candidates": [{"content": {"parts": [{"text": "yo"}]}}]}))).generate("p") == "yo"
    assert providers.Client(providers.ProviderType.OLLAMA, Fake(ok({"message": {"content": "m"}}))).chat([{"role": "user", "content": "x"}], most_tokens=5) == "m"
    for variable in ("OPENAI_API_KEY", "GOOGLE_API_KEY"):
        monkeypatch.delenv(variable, raising=False)
    monkeypatch.setenv("GROQ_API_KEY", "k")
    up = lambda method, url, *rest: ok({}) if "groq" in url else (500, b"")
    assert providers.available(up) == [providers.ProviderType.GROQ] and providers.best(up) == (None, providers.ProviderType.GROQ)
    assert providers.best(lambda *a: ok({}))[0] is providers.ProviderType.OLLAMA
    assert providers.providers(spark).filter("supports_embedding").count() == 3 and "key" not in " ".join(providers.providers(spark).columns)


def test_stream_parsers():
    assert list(providers.ndjson_pieces(['{"response": "a"}', "", '{"done": true}', '{"response": "b"}'])) == ["a", "b"]
    sse = ['data: {"choices":[{"delta":{"content":"a"}}]}', "data: {bad", ": ping", 'data: {"choices":[{"delta":{}}]}', "data: [DONE]"]
    assert list(providers.sse_pieces(sse)) == ["a"] and list(providers.word_pieces("x  y")) == ["x ", "y "]


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame([(1, "old text", 1), (1, "new text here", 2), (2, "other", 1)], "doc_id long, text string, version long").write.parquet(source)
    stream = streaming.document_stream(spark, source)
    query = streaming.write_newest_chunks(stream, lambda df, n: out.extend(df.collect()), str(tmp_path / "c"), available_now=True, strategy="fixed", chunk_size=2, overlap=0)
    query.awaitTermination(120)
    assert sorted((r.doc_id, r.version, r.text) for r in out) == [(1, 2, " here"), (1, 2, "new text"), (2, 1, "other")]
    append = streaming.chunk_stream(stream, "token", 1, 0).writeStream.format("memory").queryName("tokens").trigger(availableNow=True).start()
    append.awaitTermination(120)
    assert spark.table("tokens").count() == 6
    assert streaming.latest_by_window(spark.read.parquet(source)).count() == 2


def test_every_query_has_sql(spark):
    assert set(registry.QUERIES) == set(registry.ORACLES)
    for name in ("chunk_fixed", "vector_topk", "quick_clean"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_plans_have_no_needless_shuffle(spark):
    d = "/root/testdata/sf0.001"
    for name in ("chunk_sentence_overlap", "chunk_recursive", "chunk_overlap_next", "chunk_quality", "quick_clean"):
        assert "Exchange" not in registry.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString(), name


def test_cancel_uses_the_tag():
    class Session:
        def __init__(self):
            self.stopped = []

        def interruptTag(self, tag):
            self.stopped.append(tag)

    session = Session()
    streaming.cancel(session, "re-embed")
    assert session.stopped == ["re-embed"]


def test_requests_in_flight_are_bounded():
    import threading

    running, most, lock, tried, pauses = [0], [0], threading.Lock(), {}, []

    def call(text):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
            tried[text] = tried.get(text, 0) + 1
        try:
            if tried[text] < 3:
                raise ConnectionError
            return [float(text)]
        finally:
            with lock:
                running[0] -= 1

    assert providers.in_flight(call, [str(i) for i in range(20)], sleep=pauses.append) == [[float(i)] for i in range(20)]
    assert most[0] <= 3 and sorted(pauses) == [0.5] * 20 + [1.0] * 20
    with pytest.raises(ConnectionError):
        providers.in_flight(lambda t: tried.clear() or call(t), ["1"], sleep=pauses.append)


def test_settings_of_a_chat_reach_every_service():
    bodies = []

    def transport(method, url, headers, body, timeout):
        bodies.append(json.loads(body))
        return 200, json.dumps({"message": {"content": "a"}, "choices": [{"message": {"content": "a"}}], "candidates": [{"content": {"parts": [{"text": "a"}]}}]}).encode()

    for kind in providers.ProviderType:
        assert providers.Client(kind, transport).chat([{"role": "user", "content": "x"}], 0.2, 9) == "a"
    assert all("0.2" in json.dumps(b) and "9" in json.dumps(b) for b in bodies) and len(bodies) == 4


def test_hashing_embedders_agree(spark):
    rows = [(0, "The cat the CAT\nsat"), (1, ""), (2, None), (3, "Ünder ünder " * 50), (4, " a  b ")]
    df = spark.createDataFrame(rows, "i int, text string").withColumn("own", embed.hashing_embedding(F.col("text")))
    for r in embed.embed(df).collect():
        assert len(r.embedding) == 64 and np.allclose(r.embedding, r.own)


def test_chunk_ids_never_collide(spark):
    ids = spark.createDataFrame([(1 << 38, 5), (3, (1 << 24) - 1), (None, 1)], "doc_id long, chunk_index int").select(retrieval.chunk_id().alias("c")).collect()
    assert [r.c for r in ids] == [(1 << 38) * (1 << 24) + 5, 4 * (1 << 24) - 1, None]
    for bad in ((1 << 39, 0), (1, 1 << 24)):
        with pytest.raises(Exception, match="chunk_id"):
            spark.createDataFrame([bad], "doc_id long, chunk_index int").select(retrieval.chunk_id()).collect()
