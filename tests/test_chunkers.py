import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import chunkers
from tests import plain_spec

EDGES = [
    None, "", " \n\t", " ", "\u001f", "a", "x" * 16, "x" * 17, "one two three four five six seven", "no end here",
    "First. Second! Third? Fourth.  Fifth.\nSixth. " * 5, "\n\n" + "y" * 40 + "\n\nz", "A. " * 30, "aa aa aa aa aa aa aa aa aa aa aa aa",
    "é\U0001f600 " * 12, "p1 p1\n\np2\n \np3 is longer than the rest of them\n\n\n\np4", "trailing sep. ", "a b c. d\x1fe. f" * 4, "line\nline\nline. line " * 6,
]


def rows(spark, texts, strategy, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {}
    for r in chunkers.chunk(df, strategy, size, overlap).orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r.doc_id, []).append((r.text, r.start_pos, r.end_pos, r.unit_count))
    return out


@pytest.mark.parametrize("strategy", list(plain_spec.ALL))
@pytest.mark.parametrize("size,overlap", [(4, 0), (4, 3), (10, 2), (100, 10)])
def test_edges_match_the_plain_form(spark, strategy, size, overlap):
    got = rows(spark, EDGES, strategy, size, overlap)
    for i, text in enumerate(EDGES):
        want = plain_spec.ALL[strategy](text, size, overlap) if text and text.strip() else []
        assert got.get(i, []) == want, (i, text)


@pytest.mark.parametrize("strategy,size,overlap", [("fixed_chars", 200, 20), ("sentence", 100, 50), ("paragraph", 60, 20), ("recursive", 40, 8), ("token", 50, 10)])
def test_documents_match_the_plain_form(spark, strategy, size, overlap):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    texts = [r.text.replace("\n", "\n\n") if strategy == "paragraph" else r.text for r in docs.collect()]
    got = rows(spark, texts, strategy, size, overlap)
    assert all(got.get(i, []) == plain_spec.ALL[strategy](t, size, overlap) for i, t in enumerate(texts))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab .!\né\U0001f600", max_size=120), min_size=5, max_size=20), size=st.integers(2, 12), data=st.data())
def test_properties(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    fixed = rows(spark, texts, "fixed_chars", size, overlap)
    tokens = rows(spark, texts, "token", size, 0)
    for i, text in enumerate(texts):
        if not text.strip():
            assert i not in fixed
            continue
        assert "".join(c[0] if k == 0 else c[0][4 * overlap :] for k, c in enumerate(fixed[i])) == text
        assert "".join(c[0] for c in tokens[i]) == text
        assert all(c[2] - c[1] == len(c[0]) and text[c[1] : c[2]] == c[0] for c in fixed[i] + tokens[i])


def test_sizes_are_checked(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    for size, overlap in ((10, 10), (10, 11), (0, 0), (5, -1)):
        with pytest.raises(ValueError):
            chunkers.chunk(df, "fixed", size, overlap)
    with pytest.raises(ValueError):
        chunkers.chunk(df, "nonesuch")
    with pytest.raises(ValueError):
        chunkers.chunk(df, "custom")


def test_custom_function(spark):
    df = spark.createDataFrame([(1, "# a\nx\n# b\ny"), (2, " ")], "doc_id long, text string")

    def by_heading(text, size, overlap):
        yield ("# a\nx", 0, 5, {"title": "a"})
        yield "# b\ny"
        yield "missing"

    got = chunkers.chunk(df, "custom", 10, 0, function=by_heading).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.text, r.start_pos, r.end_pos, r.metadata, r.next_start) for r in got] == [(1, "# a\nx", 0, 5, {"title": "a"}, 6), (1, "# b\ny", 6, 11, {}, -1), (1, "missing", -1, 6, {}, None)]


def test_filters_reach_the_scan_below_chunking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = chunkers.chunk(docs, "fixed", id_cols=("doc_id", "lang")).filter(F.col("lang") == "en")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "source" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_registered_strategies(spark):
    chunkers.register("whole", lambda text, size, overlap: F.array(chunkers._chunk(text, F.lit(0), F.lit(1))), "text", "All of it")
    try:
        df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
        assert [r.text for r in chunkers.chunk(df, "whole").collect()] == ["abc"]
        assert chunkers.strategies(spark).count() == 7
    finally:
        del chunkers.REGISTRY["whole"]
