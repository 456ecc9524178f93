"""The stages on the small table with planted cases, and on odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm import brute
from tests.llm.test_ops import TEXTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    rng = random.Random(8)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    long = [r for r in docs.join(good, "doc_id", "left_semi").filter("lang = 'en'").orderBy("doc_id").collect() if 150 < len(r.text.split()) < 900][:12]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    passage = " ".join(rng.choice(["then", "there", "wand", "ester", "oned"]) + str(rng.randrange(99)) for _ in range(70))
    near = long[1].text.split()
    near[60] = "inserted"
    planted = {
        5001: long[0].text, 5002: " ".join(near), 5003: long[2].text + "\n" + item, 5004: long[3].text + " " + passage, 5005: long[4].text + " " + passage,
        5006: "junk!! " * 300, 5007: "aaa | bbb | ccc |\n" * 80,
    }
    rows = [(d, t, "en", "src0", len(t)) for d, t in planted.items()]
    table = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    path, out = tmp_path_factory.mktemp("stages"), [table]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{path}/{k}")
        out.append(spark.read.parquet(f"{path}/{k}"))
    return out, [r.doc_id for r in long], passage


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay(staged):
    out, _, _ = staged
    assert [len(pipeline.STAGES), *(o.columns for o in out[1:-1])] == [5, *[out[0].columns] * 4]
    assert all(a.dtypes == b.dtypes for a, b in zip(out[:-2], out[1:-1]))


def test_planted_cases_are_caught(staged):
    out, long, passage = staged
    quality, near, cut, clean, _ = out[1:]
    assert not ids(quality) & {5006, 5007} and set(long) <= ids(quality)
    assert not ids(near) & {5001, 5002} and {long[0], long[1]} <= ids(near)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert sum(passage in t for t in texts.values()) == 1 and passage in texts[5004]
    assert 5003 not in ids(clean)


def test_each_stage_against_brute_force(staged, spark):
    out, _, _ = staged
    before = sorted((r.doc_id, r.text) for r in out[2].collect())
    want = brute.substrings(before)
    after = {r.doc_id: r.text for r in out[3].collect()}
    assert set(after) == {d for d, (n, gone, _) in want.items() if gone < n or n == 0}
    assert all(brute.sha(b" ".join(t.encode().split())) == want[d][2] for d, t in after.items())
    assert all(t == dict(before)[d] for d, t in after.items() if want[d][1] == 0)
    for r in out[5].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == brute.LIBRARY.encode(dict((x.doc_id, x.text) for x in out[4].filter(F.col("doc_id") == r.doc_id).collect())[r.doc_id], add_special_tokens=False).ids
        break
    sets = {d: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in ((r.doc_id, r.text) for r in out[1].collect())}
    kept, gone = ids(out[2]), ids(out[1]) - ids(out[2])
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert not [(a, b) for a in kept for b in kept if a < b and alike(a, b)]
    assert all(any(alike(a, b) for b in sets if b != a) for a in gone)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score double, predicted int, held_out boolean, kept string, n_words int, ord long, key long, id long, component long, n_chars long"
    rows = [(7 * i, t, *[None] * 11) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, None, *[None] * 11), (None, TEXTS[3], *[None] * 11), (None, TEXTS[3], *[None] * 11)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in pipeline.STAGES:
            got = stage(spark, df, SF)
            count = got.count()
            assert count <= df.count() and (df.count() == 0 or count > 0)


def test_run(spark):
    got = pipeline.run(spark, SF).collect()
    assert 100 < len(got) < 200 and all(r.n_tokens * 4 == len(r.ids) for r in got) and pipeline.ORACLE_SQL is None
