"""Decisions that must not depend on the size of the input, nor leave out a part of it."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quarry.llm import common, gru, lm, simhash


def near(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.near_duplicates(docs, pipeline.SHINGLE_WORDS, pipeline.BITS, pipeline.DIFFERING, pipeline.SIMILARITY)
    return {r.doc_id: r.component for r in found.collect()}


def test_near_copies_are_the_same_in_large_buckets(spark, monkeypatch):
    rng = random.Random(4)
    texts, alike = [], []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        other = words.copy()
        for at in range(9, 9 + 9 * (k := rng.choice([3, 4, 5])), 9):
            other[at] = "changed"
        texts += [" ".join(words), " ".join(other)]
        alike.append((200 - 5 * k) / (200 + 5 * k) >= pipeline.SIMILARITY)
    assert 10 < sum(alike) < 50
    small = near(spark, texts)
    monkeypatch.setattr(simhash, "BUCKET", 1)
    large = near(spark, texts)
    assert small == large and all(large[2 * i + 1] == (2 * i if a else 2 * i + 1) for i, a in enumerate(alike))


def test_repeated_lines_and_short_texts_have_near_copies(spark):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    long = words(204)
    line = " ".join(long[40:60])
    texts = [" ".join(long), "\n".join([" ".join(long), *[line] * 29])]
    for _ in range(20):
        short = words(9)
        texts += [" ".join(short[:8]), " ".join(short)]
    texts += [" ".join(short[:7])]
    found = near(spark, texts)
    assert all(found[i] == i - i % 2 for i in range(len(texts)))


def test_recall_and_precision_of_a_large_group(spark):
    """All pairs of a group of 200 near copies that fills buckets, and of 100 other texts."""
    rng = random.Random(12)
    first = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for k in range(200):
        words = list(first)
        for at in rng.sample(range(300), rng.choice([1, 2, 4, 12, 40])):
            words[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"o{rng.randrange(10**6)}" for _ in range(120)) for _ in range(100)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in alike:
        low, high = sorted((root(i), root(j)))
        up[high] = low
    found = near(spark, texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    want, got = {p for p in pairs if root(p[0]) == root(p[1])}, {p for p in pairs if found[p[0]] == found[p[1]]}
    assert len(alike) > 2000 and len(want & got) >= 0.98 * len(want) and len(want & got) >= 0.98 * len(got)


def test_every_row_is_a_document(spark):
    rng = random.Random(13)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d = words(80), words(90), words(70), words(60)
    rows = [(1, a, "k"), (1, b, "k"), (1, a, "k"), (2, c, "k"), (None, d, "k"), (None, c, "k"), (None, words(50), "k"), (3, b + " more", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string")
    kept = pipeline.near_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == 5 and a in texts and c in texts and d in texts and (b in texts) != (b + " more" in texts)


def test_every_window_is_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(lm, "WARM_TEXTS", 0)
    texts = spark.createDataFrame([("1", " ".join(f"w{i}" for i in range(80)))], "_order string, _text string")
    voc = lm.vocabulary(lm.word_counts(texts), 1)
    start = gru.init(voc.lay, voc.counts, voc.bucket_size)
    learnt = gru.unpack(lm.train(texts, voc), start)
    moved = (learnt["input"] != start["input"]).any(1)
    assert len(voc.index) == 80 and moved[voc.token[:80]].all()


def test_outputs_grow_with_the_corpus(spark):
    counts = spark.range(400_000).selectExpr("cast(concat('w', id) as binary) word", "1 + 10000000 div (id + 1) n")
    assert lm.vocabulary(counts, 1).lay.n_words == 400_000 // 64
    assert len({lm.bucket(w + b"n") for w in (b"a", b"e", b"i", b"o")}) > 1


def test_only_texts_of_open_links_are_shuffled(spark):
    texts = spark.range(2000).select("id", F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(None, "x")], "id long, text string"))
    wanted = spark.range(5, 2000, 100)
    found = common.maybe_among(texts, wanted, "id")
    ids = {r.id for r in found.collect()}
    assert {r.id for r in wanted.collect()} <= ids and len(ids) < 40 and found.columns == ["id", "text"]
    assert common.maybe_among(texts, wanted.limit(0), "id").count() == 0
    links = spark.createDataFrame([(1, 2, 70), (3, 4, 70), (5, 6, 0)], "a long, b long, apart int")
    done = simhash.confirm(links, texts, 1, 0.3, 60)
    assert sorted(map(tuple, done.collect())) == [(1, 2), (3, 4), (5, 6)]
    # before the exchange of texts come those of links that are still open
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 4 and "_bits" in plan


def test_a_large_group_has_few_links_and_each_pair_once(spark):
    """Of 60 near copies in one bucket and in many, links within 61 bits are as many as a forest needs,
    and a pair that shares several buckets is met in one."""
    rng = np.random.default_rng(7)
    base = rng.random(512) < 0.5
    prints = [np.packbits(base ^ (rng.random(512) < 0.02)).tobytes() for _ in range(60)]
    nodes = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(prints)], "node long, fingerprint binary")
    plan = simhash.Plan([list(range(13 * k, 13 * k + 13)) for k in range(38)] + [list(range(494, 512))], [0] * 39)
    masks = simhash.bucket_masks(plan)
    links = simhash.small_links(simhash.shared_buckets(nodes, plan), nodes, 512, 94, 61, masks).collect()
    x = np.frombuffer(b"".join(prints), np.uint64).reshape(60, 8)
    assert all(r.apart == np.bitwise_count(x[r.a] ^ x[r.b]).sum() for r in links)
    every = [(i, j) for i in range(60) for j in range(i)]
    shares = [((x[i] ^ x[j]) & masks == 0).all(1).sum() for i, j in every]
    assert min(shares) >= 1 and np.mean(shares) > 10
    assert len(links) == len({frozenset((r.a, r.b)) for r in links}) <= 800 < len(every)
    assert common.components(spark.createDataFrame(links)).select("component").distinct().count() == 1


def test_trees_come_to_a_node_once(spark, monkeypatch):
    """Not to each of the many buckets that a near copy shares with the rest of its group."""
    rows = [(p, 7, 80, n) for p in range(30) for n in range(80)]
    hot = spark.createDataFrame(rows, "part int, key long, size long, node long")
    rng = np.random.default_rng(11)
    nodes = spark.createDataFrame([(n, bytearray(rng.bytes(64))) for n in range(80)], "node long, fingerprint binary")
    alone = nodes.select("node", F.col("node").alias("component"))
    sizes = []
    monkeypatch.setattr(simhash, "cut", lambda df: sizes.append(df.count()) or common.cut(df))
    assert simhash.block_links(hot, nodes, alone, 61, 94, None).count() == 0
    assert sizes == [80]


def test_few_lanes_are_scored_in_long_windows(monkeypatch):
    """One long text among short ones takes few windows, and scores do not depend on that."""
    counts = np.array([30, 50, 20, 10, 5, 5, 2, 2, 1])
    lay = gru.layout(counts, 3)
    net = gru.Network(lay, gru.init(lay, counts, np.arange(1, gru.BUCKETS + 1)))
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(1, 9 + gru.BUCKETS, n), 0) for n in [3000, *[20] * 99]]
    calls, window = [], net._window
    monkeypatch.setattr(net, "_window", lambda h, x, *more: calls.append(x.shape) or window(h, x, *more))
    got = net.log_probabilities(texts)
    assert len(calls) <= 8 and max(a * b for a, b in calls) <= 32 * 100
    monkeypatch.setattr(gru, "LONGER", 1)
    calls.clear()
    assert np.allclose(got, net.log_probabilities(texts), atol=1e-5) and len(calls) == 94
    calls.clear()
    net.learn(texts)  # in learning a window is a step, and steps are not made fewer
    assert len(calls) == 188
