"""Scoring texts with a recurrent language model that is learnt from the corpus.

Word counts cover all training texts. The most frequent words, a table of bounded
size, are broadcast; the other words of a text find their counts by a join on the
word. The network starts from a bounded sample, then every task learns from its
own texts, and the tasks' parameters are averaged slice by slice.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import bounded_sample, buffers, cut, most_frequent, remainder, slices, whole_text

#: Words with outputs of their own at least, and those whose counts are broadcast.
OUTPUT_WORDS, FREQUENT = 2_000, 150_000
#: One output for so many distinct words of the corpus, and the outputs at most: about 6 MB of parameters.
WORDS_AN_OUTPUT, MOST_OUTPUTS = 64, 16_000
#: Bytes of a word that is broadcast at the utmost, and of one that is a SHARE-th of all
#: words: the table is bounded, and no word outside it is a hot key.
LONGEST, LONGEST_HOT, SHARE = 64, 16_384, 1000
#: Texts from which the network starts, and the bytes of each at most.
WARM_TEXTS, WARM_BYTES = 600, 20_000
SLICES = 64
#: Distinct words that a task gathers before it sends their counts; bytes of text that a network takes at a time.
GATHERED, TOGETHER = 300_000, 8 << 20


def bucket(word: bytes) -> int:
    """A rare word's bucket: by its last two bytes, which tell languages and endings apart."""
    return zlib.crc32(word[-2:]) % gru.BUCKETS


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n long) over all texts of column _text, A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for part in slices(batch, "_text"):
                for text in part.column("_text").cast(pa.binary()).to_pylist():
                    seen.update(text.lower().split())
                if len(seen) > GATHERED:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return texts.select("_text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task needs of the corpus; its size does not grow with the input."""

    index: dict[bytes, int]  # of the frequent words, by falling count
    token: np.ndarray  # the network's input and output of each
    count: np.ndarray
    bucket_size: np.ndarray  # of each bucket, the sum of count + 1 over its known words, and 1 for an unknown one
    lay: gru.Layout
    counts: np.ndarray  # of the network's words, the end of text first
    ends: int
    total: int
    distinct: int

    def tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Tokens with the end; places of the words in the table (-1: not in it), and
        the words that are not in it."""
        words = text.lower().split()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        out = np.zeros(len(words) + 1, np.int32)
        out[:-1] = self.token[at]
        missed = [words[i] for i in np.flatnonzero(at < 0).tolist()]
        out[:-1][at < 0] = [bucket(w) for w in missed]
        out[:-1][at < 0] += self.lay.n_words + 1
        return out, at, missed


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """From counts of all words; only FREQUENT words and BUCKETS sums are collected."""
    size, hot = F.octet_length("word"), F.col("n") * SHARE >= (counts.agg(F.sum("n")).first()[0] or 0)
    top = most_frequent(counts.filter((size <= LONGEST) | hot & (size <= LONGEST_HOT)), "n", FREQUENT).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words, n = [bytes(w) for w in top.word], top.n.to_numpy(np.int64)
    own = words[: max(OUTPUT_WORDS, min(MOST_OUTPUTS, counts.count() // WORDS_AN_OUTPUT))]
    skip = set(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((gru.BUCKETS, 3), np.int64)
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if word in skip:
                    sums[0, 2] += 1
                else:
                    sums[bucket(word)] += (c, 1, 0)
        yield pa.RecordBatch.from_arrays([pa.array(range(gru.BUCKETS), pa.int32()), *(pa.array(sums[:, k]) for k in range(3))], ["bucket", "n", "words", "own"])

    rows = counts.select("word", "n").mapInArrow(run, "bucket int, n long, words long, own long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toPandas().set_index("bucket").reindex(range(gru.BUCKETS), fill_value=0)
    rest, rest_words = rows.n.to_numpy(np.int64), rows.words.to_numpy(np.int64)
    own_counts = np.concatenate([[ends], n[: len(own)]]).astype(np.int64)
    lay = gru.layout(own_counts, max(gru.CLASSES, round(len(own_counts) ** 0.5)))
    token = np.array([i + 1 if i < len(own) else len(own) + 1 + bucket(w) for i, w in enumerate(words)] + [0], np.int32)
    total = int(own_counts.sum() + rest.sum())
    distinct = int(len(own) + rest_words.sum() + (ends > 0))
    return Vocabulary({w: i for i, w in enumerate(words)}, token, np.append(n, 0), rest + rest_words + 1, lay, own_counts, ends, total, distinct)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in portions of about TOGETHER bytes of text, for full lanes."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "_text", TOGETHER):
            held.append(part)
            size += len(buffers(part.column("_text"))[0])
            if size >= TOGETHER:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("_text").cast(pa.binary()).to_pylist()


def train(texts: DataFrame, voc: Vocabulary) -> np.ndarray:
    """Packed parameters: a start from a bounded sample, then one pass over all
    texts, task by task, averaged by the tokens learnt from. The vectors are cut
    into slices, so no task and not the driver holds those of all tasks."""
    spark = texts.sparkSession
    net = gru.Network(voc.lay, gru.init(voc.lay, voc.counts, voc.bucket_size))
    warm = bounded_sample(texts.filter(F.octet_length("_text") <= WARM_BYTES), "_order", WARM_TEXTS).select("_text").toPandas()
    if len(warm):
        tokens = [voc.tokens(t.encode("utf-8"))[0] for t in warm._text]
        for _ in range(2):
            net.learn(tokens, 1, most=128)
    # the tasks take over the step sizes as well
    sent = spark.sparkContext.broadcast((voc, gru.pack(net.p), gru.pack(net.sums)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, flat, sums = sent.value
        net, n = gru.Network(voc.lay, unpack_like(flat, voc), unpack_like(sums, voc)), 0
        for batch in _together(batches):
            n += net.learn([voc.tokens(t)[0] for t in _texts(batch)])
        if n:
            parts = np.array_split(gru.pack(net.p), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([float(n)] * SLICES), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], ["slice", "weight", "part"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows.part.iloc[0]) // 4)
        for w, part in zip(rows.weight, rows.part):
            total += w * np.frombuffer(part, np.float32)
        return pd.DataFrame({"slice": rows.slice.iloc[:1], "part": [(total / rows.weight.sum()).astype(np.float32).tobytes()]})

    got = texts.select("_text").mapInArrow(run, "slice int, weight double, part binary").groupBy("slice").applyInPandas(mean, "slice int, part binary").toPandas().sort_values("slice")
    return np.frombuffer(b"".join(bytes(p) for p in got.part), np.float32) if len(got) else gru.pack(net.p)


def unpack_like(flat: np.ndarray, voc: Vocabulary) -> dict[str, np.ndarray]:
    return gru.unpack(flat, gru.init(voc.lay, voc.counts, voc.bucket_size))


_SCORED = "n_tokens long, n_known long, base double, model double, missed array<struct<word:binary,n:int>>"


def score_texts(df: DataFrame, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens long, base_score, score double)
    of every whole text: log10 probabilities by training frequencies and by the
    network, which learn from rows outside the held-out fold.

    A text without words is its end alone; a very long one is scored whole, in windows. A word that training lacks has the
    probability of an unknown one. Repeated rows are scored alike, null ids are
    kept and count as the empty text for the fold, other columns are left out; an
    empty table gives no rows, and without training rows all words are unknown.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), (remainder(id_col, folds) == held_out).alias("_held"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_order"), whole_text(text_col).alias("_text"))
    train_rows = rows.filter(~F.col("_held"))
    counts = cut(word_counts(train_rows))
    voc = vocabulary(counts, train_rows.count())
    sent = spark.sparkContext.broadcast((voc, train(train_rows, voc)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, flat = sent.value
        net = gru.Network(voc.lay, unpack_like(flat, voc))
        log_count = np.log10(voc.count + 1.0)
        log_bucket = np.log10(voc.bucket_size.astype(float))
        for batch in _together(batches):
            found = [voc.tokens(t) for t in _texts(batch)]
            tokens = [f[0] for f in found]
            logs = net.log_probabilities(tokens) / np.log(10)
            out, a = [], 0
            for ids, at, missing in found:
                in_table = at >= 0
                base = log_count[at[in_table]].sum() + np.log10(voc.ends + 1.0)
                rest = ids > voc.lay.n_words
                model = logs[a : a + len(ids)].sum() - log_bucket[ids[rest] - voc.lay.n_words - 1].sum() + log_count[at[rest[:-1] & in_table]].sum()
                missed = Counter(missing)
                out.append((len(ids), int(in_table.sum()) + (voc.ends > 0), base, model, [{"word": w, "n": n} for w, n in missed.items()]))
                a += len(ids)
            n, known, base, model, missed = zip(*out)
            missed_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_held"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64()), pa.array(missed, missed_type)], ["id", "held_out", "n_tokens", "n_known", "base", "model", "missed"])

    scored = cut(rows.select("_id", "_held", "_text").mapInArrow(run, f"id {kind}, held_out boolean, {_SCORED}").withColumn("row", F.monotonically_increasing_id()))
    missed = scored.select("row", F.explode("missed").alias("m")).select("row", "m.word", F.col("m.n").alias("times"))
    # words of the table never miss, and longer ones are so rare that adaptive execution deals with them
    found = missed.join(counts, "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0) * F.col("times")).alias("more"), F.sum("times").alias("known_more"))
    out = scored.drop("missed").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_more", F.lit(0))).alias("n_known"), F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * float(np.log10(voc.total + voc.distinct + 1.0))).alias("base_score"), (F.col("model") + more).alias("score"),
    )
