"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact verification.

Items and texts are sequences of words. The CGK random walk copies each word of a
sequence one time or more, as shared random functions of the word decide, so that
sequences at a small edit distance become strings at a small Hamming distance.
Sampled positions of such strings are the keys of hash tables, as many as the
target recall takes. Whatever shares a key is verified by exact edit distance.

Only windows that share a run of SEED words with an item are embedded. That loses
nothing: of the disjoint runs of an item there are more than edits allowed.
Hashes of words only lead to candidates; these are verified on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, cut, mix, slices, whole_text, window_hashes, word_hashes, word_spans

#: Edits allowed, as a share of an item's words: a similarity of 0.8 or more.
EDITS = 0.2
SEED = 3
#: Random walks, sampled positions of a key, and the recall that sets the number of keys.
WALKS, SAMPLED, RECALL = 4, 3, 0.99
#: Share of positions that edits at the limit are taken to change in an embedding.
CHANGED = 0.6
#: Bytes of item texts and items that are broadcast at a time; a larger benchmark takes
#: several passes. An item has 12 bytes in each table, about 45 MB for all of a block, and
#: its words some 100 bytes each with their seeds, 150 MB at the utmost.
ITEM_BYTES, ITEMS = 8 << 20, 50_000
#: Bytes of text that a worker searches at a time, and windows that it looks at together.
PORTION, TOGETHER = 4 << 20, 1 << 20
#: Passes over the documents, of a larger benchmark, before they are written in between.
PASSES = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def allowed(m: int) -> int:
    """Edits allowed in an item of m words, fewer than its disjoint seeds."""
    return max(0, min(math.floor(EDITS * m + 1e-9), m // min(SEED, max(m, 1)) - 1))


def tables() -> int:
    """Hash tables of each walk: all walks together reach RECALL."""
    hit = (1 - CHANGED) ** SAMPLED
    return math.ceil(math.log(1 - RECALL) / math.log(1 - hit) / WALKS)


@dataclass
class Words:
    """The words of some texts: their bytes, their hashes, each text's first one (len + 1)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def some(self, a: int, b: int) -> list[bytes]:
        return [self.data[i:j].tobytes() for i, j in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def normal_words(column: pa.Array) -> Words:
    """The words of all texts. Letters of ASCII and Latin-1 are lower-cased, ASCII
    punctuation is dropped, and so are words of nothing else."""
    data, offsets = buffers(column)
    keep = ~_MARK[data]
    upto = np.concatenate([[0], np.cumsum(keep)])
    data, offsets = _LOWER[data[keep]], upto[offsets]
    if len(data):
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = data + (capital * np.uint8(32))
    starts, ends, first = word_spans(data, offsets)
    return Words(data, starts, ends, first, word_hashes(data, starts, ends))


def walk(words: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """CGK embeddings of rows of words (zeros beyond a row's size), three symbols
    for each column. All rows share the random functions."""
    n, width = words.shape
    at, rows = np.zeros(n, np.int64), np.arange(n)
    padded = np.concatenate([words, np.zeros((n, 1), np.uint64)], 1)
    out = np.empty((n, 3 * width), np.uint64)
    for j in range(3 * width):
        out[:, j] = s = padded[rows, at]
        step = mix(s ^ np.uint64((seed * 1_000_003 + j) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(1)
        at = np.minimum(at + step.astype(np.int64), sizes)
    return out


_PLACES: dict[tuple[int, int], np.ndarray] = {}


def _places(walk_no: int, m: int) -> np.ndarray:
    """The positions that each table samples from embeddings of m words."""
    if (walk_no, m) not in _PLACES:
        rng = np.random.default_rng((walk_no, m))
        _PLACES[walk_no, m] = np.stack([rng.integers(0, 3 * m, SAMPLED) for _ in range(tables())])
    return _PLACES[walk_no, m]


def keys(words: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """For each walk the keys of all its tables, (rows, tables). Rows of other
    sizes never share a key."""
    distinct, which = np.unique(sizes, return_inverse=True)
    rows = np.arange(len(words))[:, None]
    for w in range(WALKS):
        embedded = walk(words, sizes, w)
        places = np.stack([_places(w, int(m)) for m in distinct])[which]
        key = np.repeat(mix(sizes.astype(np.uint64))[:, None], tables(), 1)
        for s in range(SAMPLED):
            key = mix(key ^ embedded[rows, places[:, :, s]]) + np.uint64(1)
        yield key


def best_match(item: list, text: list) -> tuple[int, int, int]:
    """The least edit distance of the item to any part of the text, and the part's
    start and end; of several the one that ends first, and of these the longest.

    A row of the table at a time: an entry is distance << 32 | start, so that the
    least entry is the closest and leftmost part; words lacking to the left are a
    running minimum.
    """
    n, one = len(item), 1 << 32
    number = {w: k for k, w in enumerate(item)}
    own = np.array([number[w] for w in item], np.int64)
    steps = np.arange(n + 1, dtype=np.int64) * one
    row = steps.copy()
    best = (n, 0, 0)
    new = np.empty(n + 1, np.int64)
    for j, word in enumerate(text):
        new[0] = j + 1
        np.minimum(row[:-1] + (own != number.get(word, -1)) * one, row[1:] + one, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
        if row[n] >> 32 < best[0]:
            best = (int(row[n] >> 32), int(row[n] & one - 1), j + 1)
    return best


@dataclass
class Items:
    """The items of one block, with their seeds and keys."""

    ids: list
    words: list[list[bytes]]
    hashes: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by seed length: hashes, sizes of items, offsets in them
    known: dict[int, np.ndarray]  # by seed length: a coarse table of hashes
    tables: list[tuple[np.ndarray, np.ndarray]]  # of each table the sorted keys and their items


COARSE = 1 << 20


def index_items(ids: list, texts: list[str]) -> Items:
    w = normal_words(pa.array(texts, pa.string()))
    bounds = list(zip(w.first[:-1].tolist(), w.first[1:].tolist()))
    words, hashes = [w.some(a, b) for a, b in bounds], [w.hashes[a:b] for a, b in bounds]
    seeds: dict[int, tuple] = {}
    known: dict[int, np.ndarray] = {}
    sizes = np.array([len(x) for x in hashes], np.int64)
    for q in range(1, SEED + 1):
        own = [i for i, m in enumerate(sizes.tolist()) if min(m, SEED) == q]
        if not own:
            continue
        runs = [window_hashes(hashes[i], q) for i in own]
        h = np.concatenate(runs)
        # windows depend on an item's size and the seed's place alone, however many items share it
        place = np.repeat(sizes[own], [len(x) for x in runs]) << 32 | np.concatenate([np.arange(len(x)) for x in runs])
        order = np.lexsort((place, h))
        h, place = h[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (place[1:] != place[:-1])
        seeds[q] = (h[new], (place[new] >> 32).astype(np.int32), (place[new] & (1 << 32) - 1).astype(np.int32))
        known[q] = np.zeros(COARSE, bool)
        known[q][(h & np.uint64(COARSE - 1)).astype(np.int64)] = True
    own = np.flatnonzero(sizes > 0).astype(np.int32)
    own = own[np.argsort(sizes[own], kind="stable")]
    made: list[list[np.ndarray]] = [[] for _ in range(WALKS)]
    at = 0
    while at < len(own):  # items of like sizes together, so that a long one does not widen all rows
        size = sizes[own[at:]]
        part = own[at : at + max(1, int(np.searchsorted(size, 2 * size[0], "right")))][: max(1, TOGETHER // int(size[0]))][:8192]
        rows = np.zeros((len(part), int(sizes[part].max())), np.uint64)
        rows[np.arange(rows.shape[1]) < sizes[part][:, None]] = np.concatenate([hashes[i] for i in part])
        for k, key in enumerate(keys(rows, sizes[part])):
            made[k].append(key)
        at += len(part)
    tabled = []
    for parts in made if len(own) else []:
        key = np.concatenate(parts)
        order = np.argsort(key, axis=0, kind="stable")
        tabled += [(key[order[:, t], t], own[order[:, t]]) for t in range(key.shape[1])]
    return Items(ids, words, hashes, seeds, known, tabled)


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low..high: the range's number and each place in it."""
    size = high - low
    of = np.repeat(np.arange(len(low)), size)
    return of, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[of]


def _possible(items: Items, w: Words, pairs: np.ndarray) -> np.ndarray:
    """Pairs (row, item, start) whose part of the text has enough of the item's
    words: each word that it lacks is an edit."""
    kept = [pairs[:, :0]]
    for a in range(0, pairs.shape[1], 2048):
        r, i, s = pairs[:, a : a + 2048]
        own = [items.hashes[k] for k in i.tolist()]
        size = np.array([len(x) for x in own])
        most = np.array([allowed(m) for m in size.tolist()])
        item = np.zeros((len(own), size.max()), np.uint64)
        real = np.arange(size.max()) < size[:, None]
        item[real] = np.concatenate(own)
        place = (s - most)[:, None] + np.arange(int((size + 3 * most).max()))
        inside = (place >= w.first[r][:, None]) & (place < np.minimum(w.first[r + 1], s + size + 2 * most)[:, None])
        part = np.where(inside, w.hashes[np.clip(place, 0, len(w.hashes) - 1)], np.uint64(1))
        lacking = np.zeros(len(own), np.int64)
        for c in range(item.shape[1]):
            lacking += real[:, c] & ~(part == item[:, c : c + 1]).any(1)
        kept.append(pairs[:, a : a + 2048][:, lacking <= most])
    return np.concatenate(kept, 1)


def _windows(items: Items, w: Words) -> np.ndarray:
    """(size, row, start) of the item-sized windows that share a seed with an item."""
    count = np.diff(w.first)
    owner = np.repeat(np.arange(len(count)), count)
    found = [np.zeros((3, 0), np.int64)]
    for q, (seed, size, offset) in items.seeds.items():
        h = window_hashes(w.hashes, q)
        at = np.flatnonzero(items.known[q][(h & np.uint64(COARSE - 1)).astype(np.int64)])
        at = at[owner[at] == owner[at + q - 1]] if len(at) else at
        low, high = np.searchsorted(seed, h[at], "left"), np.searchsorted(seed, h[at], "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        upto, a = np.cumsum(high - low), 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + TOGETHER, "right")))
            of, place = _expand(low[a:b], high[a:b])
            m, row = size[place].astype(np.int64), owner[at[a:b]][of]
            start = at[a:b][of] - offset[place]
            start = np.maximum(w.first[row], np.minimum(start, w.first[row + 1] - m))
            found.append(np.unique(np.stack([m, row, start]), axis=1))
            a = b
    return np.unique(np.concatenate(found, 1), axis=1)


def find(items: Items, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, first word, words) of every match in a batch of texts."""
    w = normal_words(column)
    m, row, start = _windows(items, w)
    found, a = [np.zeros((3, 0), np.int64)], 0
    while a < len(m):  # windows come by size
        b = a + min(8192, max(1, int(np.searchsorted(m[a:], 2 * m[a], "right"))), max(1, TOGETHER // int(m[a])))
        size, r, s = m[a:b], row[a:b], start[a:b]
        place = s[:, None] + np.arange(size.max())
        inside = (np.arange(size.max()) < size[:, None]) & (place < w.first[r + 1][:, None])
        rows = np.where(inside, w.hashes[np.minimum(place, len(w.hashes) - 1)], np.uint64(0))
        for k, key in enumerate(keys(rows, size)):
            for t in range(key.shape[1]):
                table, who = items.tables[k * key.shape[1] + t]
                of, at = _expand(np.searchsorted(table, key[:, t], "left"), np.searchsorted(table, key[:, t], "right"))
                if len(of):
                    found.append(np.stack([r[of], who[at].astype(np.int64), s[of]]))
        a = b
    pairs = _possible(items, w, np.unique(np.concatenate(found, 1), axis=1))
    best: dict[tuple[int, int], list] = {}
    last = (-1, -1, 0)
    for r, i, s in pairs.T.tolist():
        size, most = len(items.words[i]), allowed(len(items.words[i]))
        if (r, i) == last[:2] and s - last[2] <= most:
            continue  # what starts here lies in the part that was verified just now
        last = (r, i, s)
        a, b = max(int(w.first[r]), s - most), min(int(w.first[r + 1]), s + size + 2 * most)
        d, start_, end_ = best_match(items.words[i], w.some(a, b))
        if d <= most:
            best.setdefault((r, i), []).append((r, i, d, a + start_ - int(w.first[r]), end_ - start_))
    out = []
    for same in best.values():
        kept: list[tuple[int, int, int, int, int]] = []
        for _, _, d, s, n in sorted(same, key=lambda x: (x[2], x[3])):
            if all(s + n <= k[3] or k[3] + k[4] <= s for k in kept):
                kept.append((*same[0][:2], d, s, n))
        out += kept
    return sorted(out)


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, item_bytes: int) -> Iterator[Broadcast]:
    """Broadcast indexes of the items, block by block. A driver and a worker hold that
    of one block in memory, others lie on disk."""
    items = benchmark.select(F.col(item_col).alias("item"), whole_text(item_text_col).alias("text"))
    total, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n_blocks = max(1, -(-(total or 0) // item_bytes), -(-n // ITEMS))
    for b in range(n_blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).toPandas().sort_values("item")
        yield benchmark.sparkSession.sparkContext.broadcast(index_items(own.item.tolist(), own.text.tolist()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(id, item_id, edits int, similarity double, first_word int, n_words int): every
    place where a text holds an item with at most a fifth of its words edited.

    Words are compared without case and ASCII punctuation; first_word counts these
    words. Of overlapping places of one item the closest stays. Null and empty
    texts and items match nothing; very long texts are searched whole, one of over
    PORTION bytes by itself; repeated rows match alike; null ids are kept;
    other columns are left out; an empty table or no items give no rows. Items are
    broadcast up to item_bytes of text and ITEMS at a time, a larger benchmark in blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    arrow_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = f"id {kind}, item {item_kind}, edits int, n_item int, first_word int, n_words int"

    def block(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                for part in slices(batch, "_text", PORTION):
                    found = find(known, part.column("_text"))
                    if found:
                        r, i, d, s, n = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("_id").take(pa.array(r)), pa.array([known.ids[k] for k in i], arrow_kind), pa.array(d, pa.int32()), pa.array([len(known.words[k]) for k in i], pa.int32()), pa.array(s, pa.int32()), pa.array(n, pa.int32())],
                            ["id", "item", "edits", "n_item", "first_word", "n_words"],
                        )

        return rows.mapInArrow(run, schema)

    out = reduce(DataFrame.unionByName, map(block, _blocks(benchmark, item_col, item_text_col, item_bytes)))
    return out.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "edits", (1 - F.col("edits") / F.col("n_item")).alias("similarity"), "first_word", "n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents that hold no item, with all their columns.

    The pass that searches a text also decides on its row: no shuffle and no join, and
    every row is judged by itself, whatever its id. Null, empty and very long texts,
    repeated rows and empty tables are as in find_leaks. A benchmark of several
    blocks takes a pass each; after every PASSES the rows left are written.
    """
    at = docs.columns.index(text_col)

    def clean(rows: DataFrame, sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                for part in slices(batch, at, PORTION):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, *_ in find(known, part.column(at))]] = False
                    yield part.filter(pa.array(keep))

        return rows.mapInArrow(run, docs.schema)

    out = docs
    for k, sent in enumerate(_blocks(benchmark, item_col, item_text_col, item_bytes)):
        out = clean(cut(out) if k and k % PASSES == 0 else out, sent)
    return out
