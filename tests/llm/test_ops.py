"""Every operator on rows with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, common, decontaminate, gam, gru, jpeg, lm, registry, sharding, simhash, substrings, tokens, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, score double, fingerprint int, word string, n long, hash string, component string"
PASSAGE = " ".join(f"w{i}" for i in range(60))
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def build_texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice(["the", "of", "and", "Ünder", "ερ", "x1", "don't", "42", "end."]) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 80))) for _ in range(30)]
    near = base[3].split()
    near[len(near) // 2] = "changed"
    return [
        *base, None, "", " \n\t ", "a", "A a", PASSAGE, "before " + PASSAGE + " after", base[0], base[0], " ".join(near), "again " * 50, "x" * 30_000, "long " + " ".join(base) * 6,
        "<|endoftext|> mid<|startoftext|>dle\x00\x1f\x85 İSΣ", "😀 한국어 ǅ ﬁ é", "nbsp here and\x0bthere",
    ]


TEXTS = build_texts()


def table(spark, rows, schema=SCHEMA):
    names = [c.split()[0] for c in schema.split(", ")]
    full = [(d, t, *([None] * (len(names) - 2))) for d, t in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="module")
def rows():
    return [(7 * i % 101, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def odd(spark, rows):
    """With repeated rows and null ids as well."""
    return table(spark, [*rows, *rows[:3], (None, None), (None, TEXTS[0]), (None, TEXTS[0])])


def test_decontamination(spark, docs, empty, odd):
    words = PASSAGE.split()
    edited = [*words[:20], "other", *words[21:40], *words[41:]]
    benchmark = table(spark, [(1, " ".join(edited).upper() + "!"), (2, None), (3, ""), (4, "no such words anywhere at all"), (5, "one")], "item_id long, text string, edits int")
    found = {(r.doc_id, r.item_id): (r.edits, r.first_word, r.n_words) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    holders = [7 * i % 101 for i, t in enumerate(TEXTS) if t and PASSAGE in t]
    assert set(found) == {(d, 1) for d in holders} and all(v[0] == 2 and v[2] == 60 for v in found.values())
    assert decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    left = decontaminate.decontaminate(odd, benchmark)
    assert left.columns == odd.columns and left.count() == odd.count() - len(holders)
    blocks = decontaminate.find_leaks(docs, benchmark, item_bytes=100)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == set(found)


def test_texts_with_a_seed_and_no_key(spark):
    rng = random.Random(11)
    item = [f"q{k}" for k in range(40)]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "only seven words are in this item")], "item_id long, text string")
    rows = []
    for n in range(60):  # three words of the item in a row, and no more of them
        at = rng.randrange(37)
        rows.append((n, " ".join([f"u{rng.randrange(999)}" for _ in range(50)] + item[at : at + 3] + [f"u{rng.randrange(999)}" for _ in range(50)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = decontaminate.index_items([1], [" ".join(item)])
    assert not any(decontaminate.find(index, pa.array([t])) for _, t in rows)
    assert decontaminate.find_leaks(docs, benchmark).count() == 0
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.count() == 60 and "Join" not in (plan := clean._jdf.queryExecution().toString()) and "Exchange" not in plan
    several = decontaminate.decontaminate(docs.union(benchmark), benchmark, item_bytes=40)
    assert several.count() == 60


def test_each_row_is_judged_by_itself(spark):
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    docs = spark.createDataFrame([(None, PASSAGE), (None, "clean text"), (4, "x " + PASSAGE), (4, "clean as well"), (5, None)], "doc_id long, text string")
    assert sorted(map(str, decontaminate.decontaminate(docs, benchmark).collect())) == sorted(["Row(doc_id=None, text='clean text')", "Row(doc_id=4, text='clean as well')", "Row(doc_id=5, text=None)"])


def test_words_are_compared_and_not_their_hashes(monkeypatch):
    """With hashes that take few values, everything is a candidate."""
    monkeypatch.setattr(decontaminate, "word_hashes", lambda data, starts, ends: common.mix((ends - starts).astype(np.uint64)))
    rng = random.Random(3)
    item = [f"w{rng.randrange(10, 99)}" for _ in range(12)]
    texts = []
    for n in range(40):
        other = [f"w{rng.randrange(10, 99)}" for _ in range(12)] if n % 2 else list(item)
        other[n % 12] = "w00"
        texts.append(" ".join([f"w{rng.randrange(10, 99)}" for _ in range(5)] + other + ["zz"] * 5))
    got = {r for r, *_ in decontaminate.find(decontaminate.index_items([1], [" ".join(item)]), pa.array(texts))}
    assert got == {n for n, t in enumerate(texts) if decontaminate.best_match(item, t.split())[0] <= decontaminate.allowed(12)} and len(got) < 40


def test_best_match_against_the_plain_table():
    def plain(item, text):
        best = len(item)
        for a in range(len(text) + 1):
            row = list(range(len(item) + 1))
            for word in text[a : a + 2 * len(item)]:
                new = [row[0] + 1]
                for i, w in enumerate(item):
                    new.append(min(row[i] + (w != word), row[i + 1] + 1, new[i] + 1))
                row = new
                best = min(best, row[-1])
        return best

    rng = random.Random(7)
    for _ in range(200):
        item, text = ([rng.choice("abcd") for _ in range(rng.randrange(1, n))] for n in (7, 12))
        d, start, end = decontaminate.best_match(item, text)
        assert d == plain(item, text) and (d == len(item) or 0 <= start < end <= len(text))


def test_planted_edits_are_found():
    rng = random.Random(1)
    items = [[f"v{rng.randrange(4000)}" for _ in range(rng.randrange(3, 60))] for _ in range(40)]
    index = decontaminate.index_items(list(range(40)), [" ".join(i) for i in items])
    texts, want = [], set()
    for n in range(300):
        i = rng.randrange(40)
        w = list(items[i])
        for _ in range(rng.randint(0, decontaminate.allowed(len(w)))):
            p = rng.randrange(len(w))
            w[p : p + rng.randint(0, 1)] = [f"new{rng.randrange(10**6)}"] if rng.random() < 0.7 else []
        texts.append(" ".join([f"u{rng.randrange(9999)}" for _ in range(30)] + w + [f"u{rng.randrange(9999)}" for _ in range(30)]))
        d, _, _ = decontaminate.best_match(items[i], texts[-1].split())
        if d <= decontaminate.allowed(len(items[i])):
            want.add((n, i))
    got = {(r, i) for r, i, *_ in decontaminate.find(index, pa.array(texts))}
    assert len(got & want) >= 0.99 * len(want) and not got - want - {(r, i) for r, i in got if decontaminate.best_match(items[i], texts[r].split())[0] <= decontaminate.allowed(len(items[i]))}


def test_simhash(spark, docs, rows, empty, odd):
    got = {(r.doc_id, r.fingerprint.hex(), r.component) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute.near_components(rows)
    assert simhash.near_duplicates(empty).count() == 0
    more = simhash.near_duplicates(odd).collect()
    assert len(more) == odd.count() and all(r.component is None for r in more if r.doc_id is None)
    twice = table(spark, [(5, "one two three four"), (5, "quite other words here"), (3, "quite other words here"), (9, "one two three four")])
    assert {r.component for r in simhash.near_duplicates(twice).collect()} == {3}


def test_large_buckets_are_linked_without_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = {int(b ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j))) for b in base for i in range(64) for j in range(i, 64) if (i + j) % 7 == 0}
    some = sorted(prints)
    nodes = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in enumerate(some)], "node long, fingerprint binary")
    found = {r.node: r.component for r in common.components(simhash.near_links(nodes, 64, 2)).collect()}
    x = np.array(some, np.uint64)
    parent = list(range(len(some)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 2) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    assert all(found.get(i, i) == root(i) for i in range(len(x)))
    wide = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big") * 2)) for i, p in enumerate(some[:300])], "node long, fingerprint binary")
    blocks = {r.node: r.component for r in common.components(simhash.near_links(wide, 128, 4, choices=(5,))).collect()}
    x = x[:300]
    linked = {i: {int(j) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 2)} for i in range(300)}
    seen: dict[int, int] = {}
    for i in range(300):
        stack = [] if i in seen else [i]
        while stack:
            k = stack.pop()
            if k not in seen:
                seen[k] = i
                stack += linked[k]
    assert all(blocks.get(i, i) == seen[i] for i in range(300))


def test_similarity_is_checked_on_texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    rows, base = [], [[rng.choice(words) for _ in range(300)] for _ in range(40)]
    for i, own in enumerate(base):
        rows.append((10 * i, " ".join(own)))
        for k in range(1, 6):  # k words changed, far from each other
            edited = [f"new{k}" if j % 50 == 7 and j // 50 < k * 2 - 1 else w for j, w in enumerate(own)]
            rows.append((10 * i + k, " ".join(edited)))
    found = {r.doc_id: r.component for r in simhash.near_duplicates(table(spark, rows), 5, 512, 94, 0.8).collect()}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(296)} for d, t in rows}
    alike = [(a, b) for i in range(40) for a in range(10 * i, 10 * i + 6) for b in range(a + 1, 10 * i + 6) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(found[a] == found[b] for a, b in alike) >= 0.97 * len(alike) and all(found[d] // 10 == d // 10 for d, _ in rows)


def test_parts_follow_the_number_of_rows():
    assert simhash.layouts_for(200_000, 512, 78) == (39, 1)
    for n in (10**7, 10**9):
        m, layouts = simhash.layouts_for(n, 512, 78)
        width = 512 // m
        assert n / 2**width <= simhash.BUCKET and 1 - (1 - math.comb(434, width) / math.comb(512, width)) ** (m * layouts) >= 0.985


def test_more_layouts_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (60, 64), dtype=np.uint8)
    near = np.packbits(np.unpackbits(base, axis=1) ^ (rng.random((60, 512)) < 0.1).astype(np.uint8), axis=1)
    nodes = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate([*base, *near])], "node long, fingerprint binary")
    monkeypatch.setattr(simhash, "PART_BITS", 20)
    assert simhash.layouts_for(120, 512, 78)[1] > 1
    shared = simhash.shared_buckets(nodes, simhash.wide_plan(nodes, 512, 78))
    found = {(r.a, r.b) for r in simhash.small_links(shared, nodes, 512, 94).collect()}
    want = {(i, 60 + i) for i in range(60) if np.bitwise_count(base[i] ^ near[i]).sum() <= 94}
    assert len(want) > 50 and not found - want and len(found & want) >= 0.95 * len(want)


def test_candidates_of_a_large_group_are_a_forest(spark):
    """All pairs of the group may be near and have to be confirmed; a turn names a few of each node."""
    rng = np.random.default_rng(5)
    base = rng.random(512) < 0.5
    prints = [np.packbits(base ^ (rng.random(512) < 0.075)).tobytes() for _ in range(250)]
    nodes = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(prints)], "node long, fingerprint binary")
    x = np.frombuffer(b"".join(prints), np.uint64).reshape(250, 8)
    pairs = sum(int(((d := np.bitwise_count(x[i] ^ x[i + 1 :]).sum(1)) > 61).sum() - (d > 94).sum()) for i in range(250))
    hot = spark.range(250).selectExpr("0 part", "cast(1 as long) key", "cast(250 as long) size", "id node")
    alone = nodes.select("node", F.col("node").alias("component"))
    turns = {t: {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.block_links(hot, nodes, alone, 61, 94, t).collect()} for t in (0, 1, None)}
    assert pairs > 20_000 and len(turns[0]) <= 249 and len(turns[1]) <= 249 and len(turns[None]) > 3_000
    linked = spark.createDataFrame(list(turns[0]), "a long, b long")
    whole = common.components(linked)
    assert simhash.block_links(hot, nodes, whole, 61, 94, None).count() == 0 and whole.select("component").distinct().count() == 1


def test_components_with_hubs(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(0, i) for i in range(1, 300)] + [(i, 900) for i in range(400, 700)] + [(rng.randrange(300), 400)] + [(5000 + i, 5001 + i) for i in range(20)]
    links = spark.createDataFrame(pairs, "a long, b long")
    want = {r.node: r.component for r in common.components(links).collect()}
    monkeypatch.setattr(common, "ONE_TASK", 0)
    assert {r.node: r.component for r in common.components(links).collect()} == want
    monkeypatch.setattr(common, "HUB_ROWS", 20)
    monkeypatch.setattr(common, "HUB_SHARE", 50)
    assert {r.node: r.component for r in common.components(links).collect()} == want and set(want.values()) == {0, 5000}


def test_threshold_allocation():
    cost, t = simhash.allocate([22, 21, 21], [2**-22, 2**-21, 2**-21], 10**6, 2)
    assert t == [0, 0, 0] and cost > 0
    assert sum(x + 1 for x in simhash.allocate([32, 32], [2**-32, 0.5], 10**6, 2)[1]) == 3
    assert simhash.allocate([32, 32], [2**-32, 0.9], 10**6, 1)[1] == [1, -1]


def test_warc(spark, tmp_path):
    pages = [(1, "http://a.example.com/x?q=1#f", "<p>é</p>"), (2, "https://b.example.com:8080/", "<p>é</p>"), (3, None, None), (4, "not a url\n", ""), (5, "http://a.example.com/x?q=1", "other\r\n\r\nWARC/1.1"), (6, "http://[bad", "<p>é</p>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, d string").repartition(2)
    path = str(tmp_path / "w")
    warc.write_archive(df, path, block_lines=2)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect()}
    assert got == brute.warc(pages)
    assert {r.page_id: r.payload for r in warc.look_up(spark, path, ["http://a.example.com/x?q=1", "http://none.example/"]).collect()} == {1: None if got[1][2] == "revisit" else b"", 5: b"other\r\n\r\nWARC/1.1"}
    assert warc.write_archive(df.limit(0), str(tmp_path / "e")).count() == 0 and warc.read_archive(spark, str(tmp_path / "e")).count() == 0
    hot = spark.createDataFrame([(i, "http://h.example/", f"p{i % 3}") for i in range(40)] + [(None, None, "p0"), (39, "http://h.example/", "p0")], "page_id long, url string, html string")
    warc.write_archive(hot, str(tmp_path / "h"), least=2, block_lines=3)
    read = warc.read_archive(spark, str(tmp_path / "h"), payloads=True).collect()
    assert len(read) == 42 and sorted(r.page_id for r in warc.look_up(spark, str(tmp_path / "h"), ["http://h.example/"]).collect()) == sorted([*range(40), 39])
    assert warc.url_key("http://www.Example.com:80/a") == "com,example,www)/a"
    small = {r.page_id: r.record_type for r in warc.plan_records(hot.filter("page_id is not null"), 3).select("page_id", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type")).collect()}
    assert set(small.values()) == {"response"}


def test_archives_are_read_back_by_many_tasks(spark, tmp_path):
    pages = spark.range(300).selectExpr("id page_id", "concat('http://h', id, '.example/') url", "concat('page ', id) html").repartition(3)
    path = str(tmp_path / "many")
    warc.write_archive(pages, path, block_lines=10)
    read = warc.read_archive(spark, path).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in read.groupBy("task").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 40 and sum(sizes) == 300


def test_archives_lie_where_spark_resolves_their_path(spark, tmp_path):
    assert warc.resolved(spark, str(tmp_path / "x")) == f"file://{tmp_path}/x" == warc.resolved(spark, f"file:{tmp_path}/x") == warc.resolved(spark, f"file://{tmp_path}/x")
    with pytest.raises(ZeroDivisionError), warc._Appender(f"file://{tmp_path}", "archive", ".gz") as out:
        out.add(b"kept")
        raise ZeroDivisionError
    assert out.out.closed


def test_token_counts(docs, rows, empty, odd):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, VOCABULARY).collect()}
    assert got == {d: (len((t or "").encode()), len(brute.LIBRARY.encode(t or "", add_special_tokens=False).ids)) for d, t in rows}
    assert tokens.count_tokens(docs, VOCABULARY, frequent=3).count() == len(rows)
    assert tokens.count_tokens(empty, VOCABULARY).count() == 0 and tokens.count_tokens(odd, VOCABULARY).count() == odd.count()


def test_counting_has_no_exchange_and_a_bounded_cache(docs, rows, monkeypatch):
    plan = tokens.count_tokens(docs.coalesce(1), VOCABULARY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == docs.coalesce(1)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    monkeypatch.setattr(tokens, "CACHE_BYTES", 2_000)
    counts = tokens.Counts(VOCABULARY)
    for _ in range(2):
        for _, t in rows:
            assert counts.of([(t or "").encode()], {}) == [len(brute.LIBRARY.encode(t or "", add_special_tokens=False).ids)]


def test_only_known_files_are_cut_at_white_space(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    assert tokens.Counts(VOCABULARY).words and not tokens.Counts(path).words
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()} == {d: len(own.encode(t or "", add_special_tokens=False).ids) for d, t in rows}


def test_sentence_pieces(docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()} == {d: len(own.encode(t or "")) for d, t in rows}


def test_substrings(spark, docs, rows, empty, odd):
    digest = lambda df: {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()}
    assert digest(substrings.dedup_substrings(docs)) == brute.substrings(sorted(rows, key=lambda r: r[0]))
    for length in (2, 3, 7):
        assert digest(substrings.dedup_substrings(docs, length)) == brute.substrings(sorted(rows, key=lambda r: r[0]), length)
    assert substrings.dedup_substrings(empty).count() == 0 and substrings.dedup_substrings(odd).count() == odd.count()
    same = table(spark, [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (None, "z " + PASSAGE)])
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup_substrings(same).collect()) == [(0, 0), (1, 60), (1, 60), (2, 60)]


def test_settling_in_small_portions(monkeypatch):
    monkeypatch.setattr(substrings, "GATHERED", 50)
    part = pa.RecordBatch.from_pydict({"ord": [1, 2], "key": [1, 2], "_text": ["x " + PASSAGE, PASSAGE + " y"]})
    sent = list(substrings._anchor_rows(iter([part]), 20, 10, None))
    assert sent and all(b.num_rows for b in sent)


def test_a_common_passage_is_a_row_a_task(monkeypatch):
    """However many portions a task has, a hash that repeats in it goes out once."""
    monkeypatch.setattr(substrings, "GATHERED", 50)
    monkeypatch.setattr(common, "CHUNK_BYTES", 300)
    batches = [pa.RecordBatch.from_pydict({"ord": [4 * n + k for k in range(4)], "key": [0] * 4, "_text": [f"x{n}{k} " + PASSAGE for k in range(4)]}) for n in range(30)]
    rows = [r for b in substrings._anchor_rows(iter(batches), 20, 5, None) for r in b.to_pylist() if r["many"] is None]
    assert len(batches) == 30 and max(Counter(r["slot"] for r in rows).values()) <= 2
    rows = [r for b in substrings._window_rows(iter(batches), 20, None) for r in b.to_pylist()]
    single = Counter((r["h1"], r["rest"] >> 32) for r in rows if r["many"] is None)
    assert max(single.values()) == 1 and sum(len(r["many"]) // 4 for r in rows if r["many"]) == 119 * 41


def test_levels_double():
    assert substrings.levels(20) == [5, 10, 20] and substrings.levels(9) == [5, 9] and substrings.levels(7) == [7] and substrings.levels(100) == [7, 13, 25, 50, 100]


def test_words_that_collide_in_polynomial_hashes_are_told_apart(spark):
    """Thue-Morse words have equal polynomial hashes modulo 2^64, whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    data, offsets = common.buffers(pa.array([one, two]))
    starts, ends, _ = common.word_spans(data, offsets)
    assert len(set(common.word_hashes(data, starts, ends).tolist())) == 1
    words = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([one, *words])), (2, " ".join([two, *words])), (3, " ".join(["x", two, *words, "y"]))]
    got = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(table(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_media(docs, rows, empty, odd):
    stored = jpeg.store_texts(docs)
    read = jpeg.read_media(stored, keep=("doc_id", "n_bytes")).collect()
    for r in read:
        data = (dict(rows)[r.doc_id] or "").encode()
        assert bytes(r.thumbnail) == data.ljust(max(64, -(-len(data) // 64) * 64), b"\0") and r.n_bytes == len(data)
        assert r.width == 512 and r.height == len(r.thumbnail) // 64 * 8
    assert jpeg.store_texts(empty).count() == 0 and jpeg.store_texts(odd).count() == odd.count()
    data = np.frombuffer(bytes(range(256)) * 2500, np.uint8)
    media = jpeg.write_payloads(data, np.array([0, len(data)]))
    frames = jpeg.read_many(media)[0]
    assert len(frames) == 2 and b"".join(g.tobytes() for _, g in frames) == data.tobytes()
    assert jpeg.read_many([b"", b"\xff\xd8\xff", media[0][:900], media[0]])[:3] == [None] * 3


def test_other_jpegs():
    """Three components, subsampled, with AC coefficients and restart intervals."""
    dc = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, *range(12)])
    ac = bytes([0, 2, 1, 1, *[0] * 12, 0x00, 0x01, 0x11, 0xF0])
    bits = ""

    def codes(table):
        out, code, k = {}, 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                out[table[k]] = f"{code:0{n}b}"
                code, k = code + 1, k + 1
            code <<= 1
        return out

    d_code, a_code = codes(dc), codes(ac)

    def block(diff, coefficients):
        size = abs(diff).bit_length()
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        out = d_code[size] + (f"{extra:0{size}b}" if size else "")
        return out + "".join(a_code[1] + "1" for _ in range(coefficients)) + (a_code[0] if coefficients < 63 else "")

    scan = b""
    want, rng = [], random.Random(2)
    for interval in range(4):  # one MCU each: four luminance blocks and two of colour
        bits, before = "", [0, 0, 0]
        for component in (0, 0, 0, 0, 1, 2):
            value = rng.randrange(-100, 100)
            bits += block(value - before[component], rng.choice([0, 1, 5, 63]))
            before[component] = value
            if component == 0:
                want.append(value)
        bits += "1" * (-len(bits) % 8)
        scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + interval]) if interval < 3 else b"")
    part = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    head = b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, bytes([0, 4, *[9] * 63])) + part(0xC0, bytes([8, 0, 30, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    image = head + part(0xC4, bytes([0]) + dc + bytes([0x10]) + ac) + part(0xDD, bytes([0, 1])) + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (frame, grid), = jpeg.read_many([image])[0]
    assert (frame.width, frame.height) == (32, 30)
    rows = np.array(want).reshape(2, 2, 2, 2).transpose(0, 2, 1, 3).reshape(4, 4)
    assert (grid == np.clip((rows * 4 + 4) // 8 + 128, 0, 255)).all()
    # a scan for each component: luminance block by block, colours in scans of their own
    scans, values = b"", [rng.randrange(-100, 100) for _ in range(16)]
    for component, blocks in ((1, values), (2, [3] * 4), (3, [5] * 4)):
        bits, before = "", 0
        for value in blocks:
            bits += block(value - before, rng.choice([0, 2, 63]))
            before = value
        bits += "1" * (-len(bits) % 8)
        scans += part(0xDA, bytes([1, component, 0, 0, 63, 0])) + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    apart = head + part(0xC4, bytes([0]) + dc + bytes([0x10]) + ac) + scans + b"\xff\xd9"
    (frame, grid), = jpeg.read_many([apart])[0]
    assert (frame.width, frame.height) == (32, 30) and (grid == np.clip((np.array(values).reshape(4, 4) * 4 + 4) // 8 + 128, 0, 255)).all()
    assert jpeg.read_many([apart[:-2], apart + image])[0] is None and len(jpeg.read_many([apart + image])[0]) == 2


def test_sharding(spark, docs, rows, empty, odd):
    for limit in (300, 3000, 10**6):
        got = sharding.assign_shards(docs, limit).collect()
        assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
        shards = {}
        for r in got:
            assert r.hash >> (60 - r.shard_depth) == r.shard_prefix
            shards.setdefault((r.shard_depth, r.shard_prefix), []).append(r)
        for own in shards.values():
            assert own[0].shard_bytes == sum(r.n_bytes for r in own) and (own[0].shard_bytes <= limit or len(own) == 1) and own[0].oversized == (own[0].shard_bytes > limit)
        assert not any(a != b and a[0] < b[0] and b[1] >> (b[0] - a[0]) == a[1] for a in shards for b in shards)
        parents = {}
        for (depth, prefix), own in shards.items():
            if depth:
                parents.setdefault((depth - 1, prefix >> 1), 0)
        size = lambda p: sum(r.n_bytes for r in got if r.hash >> (60 - p[0]) == p[1])
        assert all(size(p) > limit for p in parents)
    assert sharding.assign_shards(empty).count() == 0 and sharding.assign_shards(odd, 300).count() == odd.count()


def test_shards_split_where_they_are_full(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(400)) for i in range(400)] + [(1000, "y" * 9000)] + [(7, "same " * 30)] * 60
    df = table(spark, rows)
    got = sharding.assign_shards(df, 1000).collect()
    depths = {r.shard_depth for r in got}
    assert len(got) == 461 and len({(r.shard_depth, r.shard_prefix) for r in got}) > 60 and len(depths) > 3
    assert {r.doc_id for r in got if r.oversized} == {1000, 7} and all(r.shard_bytes <= 1000 for r in got if not r.oversized)
    plan = sharding.assign_shards(df, 1000)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Cartesian" not in plan


def test_shards_are_written(spark, tmp_path, docs, odd):
    for df, limit in ((docs, 3000), (odd, 10**6), (odd.limit(0), 100)):
        path = str(tmp_path / str(limit))
        sharding.write_shards(df, path, limit)
        if not df.take(1):
            continue
        back = spark.read.parquet(path)
        assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
        want = {(r.doc_id, r.shard_depth, r.shard_prefix) for r in sharding.assign_shards(df, limit).collect()}
        assert {(r.doc_id, r.shard_depth, r.shard_prefix) for r in back.collect()} == want


def test_kept_words_are_bounded(monkeypatch):
    kept = bpe.Kept(5_000)
    for i in range(200):
        for k in kept.missing({f"w{i}", f"w{i // 2}", "often"}):
            kept.put(k, k.encode(), b"x" * 10)
        assert kept.ids["often"] == b"often" and kept.held <= 6_000 and len(kept.older[0]) < 30


def test_bpe(docs, rows, empty, odd):
    for r in bpe.encode(docs, VOCABULARY).collect():
        ids = brute.LIBRARY.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == brute.LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty, VOCABULARY).count() == 0 and bpe.encode(odd, VOCABULARY).count() == odd.count()


def test_words_are_coded_together(monkeypatch):
    enc = bpe.encoder(VOCABULARY)
    rng = random.Random(8)
    words = ["it's", "'s's", "''s", "'sa", "we'LL", "'lL'", "x'", "o'r'e", "'re've'm'd't", "a1b22", "...", "\u00c4\u00dfx", "\u00b2\u00bd", "e\u0301", "\u4e2d\u6587", "\u0130", "<|endoftext|>", "\u00a0", "\u2003", "\u212a'S"]
    words += ["".join(rng.choice("aZ'sStl1.\u00e9\u00c9\u017f\u01c5\u0391") for _ in range(rng.randrange(1, 12))) for _ in range(2000)] + ["q" * 300, *enc.special]
    raw = [w.encode() for w in words]
    for part in (raw, raw[14:15], [], raw[:1]):
        coded = enc.code_words(part)
        for w, ids, text in zip(part, coded, enc.decode_many(coded), strict=True):
            want = brute.LIBRARY.encode(w.decode(), add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and text.decode() == brute.LIBRARY.decode(want, skip_special_tokens=False), w
    monkeypatch.setattr(bpe, "DECODED", 3)
    coded = enc.code_words(raw[:40])
    assert [t.decode() for t in enc.decode_many([b"", *coded, b""])] == ["", *(enc.decode(np.frombuffer(c, "<u4").tolist()) for c in coded), ""]
    # no work in Python for each word's pieces: only odd words ask the library
    seen = []
    monkeypatch.setattr(enc, "_symbols", lambda p: seen.append(p) or [])
    enc.code_words([b"plain", b"words,", "caf\u00e9".encode()])
    assert not seen


def test_trees_agree():
    enc = bpe.encoder(VOCABULARY)
    rng = random.Random(4)
    pieces = ["".join(rng.choice("aeinrst") for _ in range(n)) for n in [*range(1, 70), 200, 1000]]
    symbols = [enc._symbols(p) for p in pieces]
    one = [enc.merge_one(s) for s in symbols]
    short = [s for s in symbols if len(s) <= bpe.SHORT]
    assert enc.merge_many(short) == one[: len(short)]
    assert one == [brute.LIBRARY.encode(p, add_special_tokens=False).ids for p in pieces]


def test_classifier(spark, docs, empty, odd):
    def auc(frame):
        good, bad = frame[frame.quality == 1].score.to_numpy(), frame[frame.quality == 0].score.to_numpy()
        return (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2

    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = gam.classify(data, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert auc(held) > 0.95 and ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5) == 0).all()
    none = labels.limit(0)
    assert gam.classify(docs, none).select("score").distinct().count() == 1
    mixed = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (7, 0)], "doc_id long, quality int")
    assert gam.classify(odd, mixed).count() == odd.count() and gam.classify(empty, mixed).count() == 0


def test_pairs_of_features_are_learnt():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert model.pairs[0][:2] == (0, 1) and ((model.scores(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.85


def test_language_model(spark, docs, rows, empty, odd):
    def check(frame, source):
        want = brute.unigram(source)
        for r, w in zip(sorted(frame.collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score)), sorted(want, key=lambda w: (str(w[0]), w[2], w[5]))):
            assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5] and math.isclose(r.base_score, w[5], rel_tol=1e-9) and r.score < 0

    check(lm.score_texts(docs), rows)
    check(lm.score_texts(odd), [*rows, *rows[:3], (None, None), (None, TEXTS[0]), (None, TEXTS[0])])
    assert lm.score_texts(empty).count() == 0


def test_rare_words_are_joined(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 20)
    monkeypatch.setattr(lm, "OUTPUT_WORDS", 5)
    got = {r.doc_id: r.base_score for r in lm.score_texts(docs).collect()}
    assert all(math.isclose(got[w[0]], w[5], rel_tol=1e-9) for w in brute.unigram(rows))


def test_held_out_texts_get_likelier(spark):
    got = lm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").toPandas()
    assert (got.score > got.base_score).mean() > 0.9 and got.score.sum() > got.base_score.sum() * 0.97


def test_probabilities_add_up():
    counts = np.array([30, 50, 20, 10, 5, 5, 2, 2, 1])
    lay = gru.layout(counts, 3)
    net = gru.Network(lay, gru.init(lay, counts, np.arange(1, gru.BUCKETS + 1)))
    start = [np.array([t]) for t in range(lay.n_words + 1 + gru.BUCKETS)]
    assert math.isclose(np.exp(net.log_probabilities(start)).sum(), 1, rel_tol=1e-5)
    texts = [np.array([3, 1, 0]), np.array([2, 0]), np.array([1, 1, 1, 1, 4, 0]), np.array([0])]
    alone = np.concatenate([net.log_probabilities([t]) for t in texts])
    assert np.allclose(net.log_probabilities(texts, width=2, most=2), alone, atol=1e-5)


def test_gradients():
    counts = np.array([3, 5, 2, 2, 1])
    lay = gru.layout(counts, 2)
    params = {k: v.astype(np.float64) for k, v in gru.init(lay, counts, np.ones(gru.BUCKETS)).items()}
    net = gru.Network(lay, params)
    text = [np.array([1, 3, 5, 2, 0])]
    seen = {}
    net._update = lambda grads, n, rate: seen.update(grads)
    net.learn(text, width=8)
    for k in ("state", "class", "word", "gate", "word_bias"):
        at = tuple(s // 2 for s in params[k].shape)
        old = params[k][at]
        params[k][at] = old + 1e-4
        up = net.log_probabilities(text).sum()
        params[k][at] = old - 1e-4
        down = net.log_probabilities(text).sum()
        params[k][at] = old
        assert math.isclose(-(up - down) / 2e-4, seen[k][at], rel_tol=2e-2, abs_tol=2e-4), k


def test_word_hashes_and_windows():
    texts = ["a bb a bb ccc", "", " bb ccc\x00 ", "a bb a bb ccc"]
    data, offsets = common.buffers(pa.array(texts))
    starts, ends, first = common.word_spans(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [w for t in texts for w in t.encode().split()] and first.tolist() == [0, 5, 5, 7, 12]
    h = common.word_hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] == h[5] and h[4] != h[6]
    for length in (1, 2, 3, 4, 5):
        w = common.window_hashes(h, length)
        assert w[0] == w[7] and (length > 2 or w[0] == w[2])


def test_word_hashes_do_not_depend_on_portions(monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcd") for _ in range(rng.choice([1, 3, 9, 40, 700]))) for _ in range(60))
    data, offsets = common.buffers(pa.array([text]))
    starts, ends, _ = common.word_spans(data, offsets)
    whole = [common.word_hashes(data, starts, ends, lane) for lane in (0, 1)]
    for size in (16, 100, 650):
        monkeypatch.setattr(common, "CHUNK_BYTES", size)
        monkeypatch.setattr(common, "_POWERS", {})
        assert all((common.word_hashes(data, starts, ends, lane) == whole[lane]).all() for lane in (0, 1))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(500, 500), (7, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(31), 300]) and all(got[i] == 100 for i in range(100, 160)) and 500 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registered_queries(spark):
    assert [n for n in registry.QUERIES if n.startswith("op")] == [q for q in registry.QUERIES]
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))
    frame = registry.QUERIES["op2_simhash_near_dedup"](spark, "/root/testdata/sf0.001")
    assert isinstance(frame.toPandas(), pd.DataFrame)
