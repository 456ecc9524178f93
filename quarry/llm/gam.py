"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one feature at a time, boosted in cycles, add up to one lookup
table a feature; then trees that cut two features once each add up to tables of
pairs. Scoring finds each feature's bin and adds table entries, for many texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bounded_sample, buffers, remainder, slices, whole_text, word_hashes, word_spans

#: Labelled rows that a fit takes at most, an even share by a hash of their id: the
#: bound on what reaches the driver.
TRAINING_ROWS = 20_000
BINS, PAIR_BINS = 64, 12
CYCLES, PAIR_CYCLES, RATE = 120, 60, 0.15
PAIRS = 12

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "longest_word", "short_words", "distinct_words", "repeats_before", "top_word", "upper", "digit", "space", "newline", "full_stop", "comma", "exclamation",
    "pipe", "symbol", "other_ascii", "non_ascii", "upper_starts", "symbol_ends", "line_words", "byte_entropy",
)

_CLASSES = ("lower", "upper", "digit", "space", "newline", "full_stop", "comma", "exclamation", "pipe", "symbol", "other_ascii", "non_ascii")
_CLASS = np.full(256, _CLASSES.index("other_ascii"), np.int64)
_CLASS[128:] = _CLASSES.index("non_ascii")
for _name, _bytes in (("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("full_stop", b".?"), ("comma", b",;:"), ("exclamation", b"!"), ("pipe", b"|"), ("symbol", b"#$%&*@^~_=+<>{}[]\\/")):
    _CLASS[list(_bytes)] = _CLASSES.index(_name)


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    data, offsets = buffers(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    bytes_of = np.zeros(n * 256, np.int64)
    for at in range(0, len(data), CHUNK_BYTES):  # a very long text takes several portions
        part = data[at : at + CHUNK_BYTES]
        of = np.searchsorted(offsets, np.arange(at, at + len(part)), "right") - 1
        low = int(of[0])
        found = np.bincount((of - low) * 256 + part)
        bytes_of[low * 256 : low * 256 + len(found)] += found
    bytes_of = bytes_of.reshape(n, 256)
    counts = bytes_of @ (_CLASS[:, None] == np.arange(len(_CLASSES))).astype(np.int64)
    share = counts / np.maximum(size, 1)[:, None]
    letters = bytes_of / np.maximum(size, 1)[:, None]
    entropy = -(letters * np.log(np.where(letters > 0, letters, 1))).sum(1)

    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    per = lambda x: np.bincount(owner, x, n) / some
    mean = per(length)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    hashes = word_hashes(data, starts, ends)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, o[new], runs)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    first_kind, last_kind = (_CLASS[data[at]] if len(at) else at for at in (starts, ends - 1))
    at = {c: share[:, i] for i, c in enumerate(_CLASSES)}
    columns = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(words), "word_bytes": mean, "word_bytes_sd": np.sqrt(np.maximum(per(length**2) - mean**2, 0)), "longest_word": np.log1p(longest), "short_words": per(length <= 3),
        "distinct_words": np.bincount(o[new], minlength=n) / some, "repeats_before": per(again), "top_word": top / some, "upper_starts": per(first_kind == _CLASSES.index("upper")), "symbol_ends": per(last_kind == _CLASSES.index("symbol")),
        "line_words": np.log1p(words / (1 + counts[:, _CLASSES.index("newline")])), "byte_entropy": entropy,
    }
    return np.stack([columns[f] if f in columns else at[f] for f in FEATURES], 1)


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]  # of each feature's bins
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, f], "right")]
        bins = {f: np.searchsorted(self.pair_edges[f], x[:, f], "right") for i, j, _ in self.pairs for f in (i, j)}
        for i, j, table in self.pairs:
            out += table[bins[i], bins[j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="nearest")) if len(values) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a shallow tree over ordered bins, as a table."""
    cuts, out = [(0, len(g))], np.zeros(len(g))
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(cuts) < leaves:
        best = (1e-9, None, None)
        for a, b in cuts:
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = value(a, m) + value(m, b) - value(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (a, b), int(m[k]))
        if best[1] is None:
            break
        cuts.remove(best[1])
        cuts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in cuts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Newton steps of a tree of four leaves over the grid of two features: one cut of
    each, chosen together, since neither may gain anything alone."""
    cg, ch = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (g, h))

    def quarters(upto: np.ndarray) -> list[np.ndarray]:
        rows, cols, whole = upto[:, -1:], upto[-1:], upto[-1, -1]
        return [upto, rows - upto, cols - upto, whole - rows - cols + upto]

    parts = list(zip(quarters(cg), quarters(ch)))
    gain = sum(a**2 / (b + ridge) for a, b in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    steps = [float(a[i, j] / (b[i, j] + ridge)) for a, b in parts]
    out = np.empty_like(g)
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = steps
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting. Without both labels every score is the smoothed base rate."""
    n, d = x.shape
    rate = (y.sum() + 1) / (n + 2)
    model = Model(float(np.log(rate / (1 - rate))), [], [], [], [])
    if n == 0 or len(np.unique(y)) < 2:
        model.edges, model.tables = [np.zeros(0)] * d, [np.zeros(1)] * d
        return model
    model.edges = [_edges(x[:, f], BINS) for f in range(d)]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logit = np.full(n, model.base)
    for _ in range(CYCLES):
        for f in range(d):
            p = 1 / (1 + np.exp(-logit))
            size = len(model.tables[f])
            step = RATE * _tree(np.bincount(bins[f], y - p, size), np.bincount(bins[f], p * (1 - p), size))
            model.tables[f] += step
            logit += step[bins[f]]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(d)]
    small = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = len(model.pair_edges[j]) + 1
        cell = small[i] * width + small[j]
        size = (len(model.pair_edges[i]) + 1) * width
        p = 1 / (1 + np.exp(-logit))
        return np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size), cell

    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            g, h, _ = sums(i, j)
            gains.append((float((g**2 / (h + 2)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    tables = {c: np.zeros((len(model.pair_edges[c[0]]) + 1) * (len(model.pair_edges[c[1]]) + 1)) for c in chosen}
    for _ in range(PAIR_CYCLES):
        for c in chosen:
            g, h, cell = sums(*c)
            shape = (len(model.pair_edges[c[0]]) + 1, -1)
            step = RATE * _pair_tree(g.reshape(shape), h.reshape(shape)).ravel()
            tables[c] += step
            logit += step[cell]
    model.pairs = [(i, j, tables[i, j].reshape(len(model.pair_edges[i]) + 1, -1)) for i, j in chosen]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `most` labelled documents outside the held-out
    fold, an even share by a hash of their id. A document labelled twice takes the
    larger label; null labels and ids are left out."""
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held_out))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    own = bounded_sample(own, "doc_id", most)
    rows = docs.select("doc_id", whole_text().alias("_text")).join(F.broadcast(own), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                x = features(part.column("_text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    found = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x array<double>")
    # One row an id, so that repeated rows don't exceed the bound.
    got = found.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    return np.array(got.x.tolist(), float).reshape(len(got), len(FEATURES)), got.y.to_numpy(float)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, score double) of every whole text; one pass, no shuffle."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    cols = [id_col, *keep]
    read = text_col if text_col in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, read):
                values = sent.value.scores(features(part.column(read)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in cols), pa.array(values)], [*cols, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols) + ", score double"
    return docs.select(*cols, *([] if read == text_col else [whole_text(text_col).alias("_text")])).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, cut: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, held_out boolean, score double, predicted int) a row.

    Learns from labelled rows outside the held-out fold, the remainder of
    crc32(doc_id as text). Null and empty texts are scored like any other, from
    zero features, and very long ones whole; repeated rows and null ids are kept; an
    empty table gives no rows; without labels every score is the same. Columns of `docs` that share a name with the labels' are
    never read.
    """
    model = fit(*training_rows(docs, labels, label, folds, held_out))
    out = score(docs, model, keep=keep)
    return out.select("doc_id", *keep, (remainder("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
