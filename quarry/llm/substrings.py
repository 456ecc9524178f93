"""Exact substring dedup by level-wise doubling.

The first level finds short windows that repeat, and each further one windows of twice
the words, but only where all before it found a repeat, up to the full length. Below it a
window of the full length is stood for by the least hash among the level's windows
in it, so that equal windows choose alike and few hashes are shuffled; such hashes only
lead to candidates. At the full length the windows themselves are told apart by 96
bits of BLAKE2b over their words, a hash for which colliding words cannot be built
by rule, and held against the first document that has them.

Tasks settle what repeats among their own rows and send a hash that repeats here only
once, so a passage that a third of all documents share is a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, mix, slices, whole_text, window_hashes, word_hashes, word_spans

#: Hashes that a task gathers before it settles them, and rows that it sends at a time.
GATHERED, SENT = 500_000, 50_000
#: Repeated hashes that a task remembers to have sent.
TOLD = 1_000_000
#: Words of a window of the first level, at least (those of a shorter length are its only level).
SHORTEST = 5


def levels(length: int) -> list[int]:
    """Lengths of the levels, each twice the one before (less one, where it must be)."""
    out = [length]
    while -(-out[0] // 2) >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of `width` entries."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


class Windows:
    """Windows of `length` words of a batch of texts; none runs over a text's end."""

    def __init__(self, column: pa.Array, length: int):
        self.length = length
        self.data, offsets = buffers(column)
        self.starts, self.ends, self.first = word_spans(self.data, offsets)
        self.words = word_hashes(self.data, self.starts, self.ends)
        count = np.diff(self.first)
        owner = np.repeat(np.arange(len(count)), count)
        left = np.repeat(self.first[1:], count) - np.arange(len(owner))  # words up to the text's end
        n = max(0, len(owner) - length + 1)
        self.owner, self.valid = owner, left[:n] >= length

    def anchors(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window the least hash of the level's windows in it, and all of these."""
        pieces = window_hashes(self.words, level) | np.uint64(1)
        return (_slide(pieces, self.length - level + 1, np.minimum) if len(self.valid) else pieces[:0]), pieces

    def chosen(self, level: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the level's windows that a living window chose."""
        least, pieces = self.anchors(level)
        if not len(least):
            return np.zeros(0, np.int64), pieces[:0]
        width = self.length - level + 1
        shown = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        shown[width - 1 : width - 1 + len(least)] = np.where(alive, least, 0)
        at = np.flatnonzero(_slide(shown, width, np.maximum) == pieces)
        return at, pieces[at]

    def alive(self, first: np.ndarray, level: int | None, repeated: list[list[bytes]]) -> np.ndarray:
        """Windows of first rows whose anchor of the level before repeats, by each text's list."""
        out = self.valid & first[self.owner[: len(self.valid)]]
        if level is not None and out.any():
            at = np.flatnonzero(out)
            lists = [np.frombuffer(b"".join(x), np.uint64) for x in repeated]
            salt = mix(np.arange(len(lists), dtype=np.uint64))
            known = np.concatenate(lists) ^ np.repeat(salt, [len(x) for x in lists])
            out[at] = np.isin(self.anchors(level)[0][at] ^ salt[self.owner[at]], known)
        return out

    def digests(self, at: np.ndarray) -> np.ndarray:
        """96 bits of BLAKE2b over the words of windows: 64 and 32, as (windows, 2)."""
        out, line, done = [], b"", -1
        for k, text in zip(at.tolist(), self.owner[at].tolist()):
            if text != done:
                a, b = int(self.first[text]), int(self.first[text + 1])
                line = b" ".join([self.data[i:j].tobytes() for i, j in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())])
                begin = np.concatenate([[0], np.cumsum(self.ends[a:b] - self.starts[a:b] + 1)]).tolist()
                done = text
            out.append(blake2b(line[begin[k - a] : begin[k - a + self.length] - 1], digest_size=12).digest())
        words = np.frombuffer(b"".join(out), "<u4").reshape(-1, 3).astype(np.uint64)
        return np.stack([words[:, 0] << np.uint64(32) | words[:, 1], words[:, 2]], 1)


def _identity(id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> list[F.Column]:
    """Rows of one id and one text are one document; documents go by id, nulls
    first, then by a hash of the text."""
    text = whole_text(text_col)
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    return [F.col(id_col).alias("id"), *keep, order.alias("ord"), F.xxhash64(F.lit(7), text).alias("key"), text.alias("_text")]


class _Seen:
    """Documents of what a task has gathered since it last sent."""

    def __init__(self) -> None:
        self.index: dict[tuple[int, int], int] = {}

    def rows(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's document, and whether the row is its first."""
        ids, new = [], []
        for k in zip(part.column("ord").to_pylist(), part.column("key").to_pylist()):
            new.append(k not in self.index)
            ids.append(self.index.setdefault(k, len(self.index)))
        return np.array(ids, np.int64), np.array(new, bool)

    def identities(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.array(list(self.index), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _lists(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Values of each document, as bytes; `doc` is sorted."""
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    ends = np.append(at[1:], len(doc))
    raw, size = values.tobytes(), values.itemsize
    return doc[at], [raw[a * size : b * size] for a, b in zip(at.tolist(), ends.tolist())]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, SENT):
        yield batch.slice(at, SENT)


class _Told:
    """What a task has sent of hashes that repeat within it: for each the least document
    so far. A full table is forgotten, and its hashes are sent once more."""

    def __init__(self) -> None:
        self.least: dict[bytes, tuple[int, int]] = {}

    def earlier(self, hashes: list[bytes], docs: list[tuple[int, int]], repeated: list[bool]) -> np.ndarray:
        """For each hash, with the least document of a portion that has it and whether the
        portion repeats it, whether an earlier document has been sent."""
        if len(self.least) > TOLD:
            self.least.clear()
        out = np.zeros(len(hashes), bool)
        for k, (h, doc, again) in enumerate(zip(hashes, docs, repeated)):
            known = self.least.get(h)
            if known is not None and known < doc:
                out[k] = True
            elif again or known is not None:
                self.least[h] = doc
        return out


_ANCHOR_ROWS = "slot long, ord long, key long, twice boolean, many binary"


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, level: int, before: int | None) -> Iterator[pa.RecordBatch]:
    """Hashes of the level's windows. A row is a hash and a document that asks whether it
    repeats; or tells that it does (twice); or is a document's list of those that do."""
    hashes: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    seen, held, told = _Seen(), 0, np.zeros(0, np.uint64)

    def send() -> pa.RecordBatch:
        nonlocal told
        h, d = np.concatenate(hashes), np.concatenate(docs)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new) - 1
        again = np.bincount(group) > 1
        old = np.isin(h[new], told, assume_unique=True)  # repeats, and others know
        repeated = (again | old)[group]
        ords, keys = seen.identities()
        # what repeats here is known for its documents; each hash is also held against other tasks
        k, kd = h[repeated], d[repeated]
        order = np.lexsort((k, kd))
        k, kd = k[order], kd[order]
        distinct = np.ones(len(k), bool)
        distinct[1:] = (k[1:] != k[:-1]) | (kd[1:] != kd[:-1])
        whose, many = _lists(kd[distinct], k[distinct])
        # rows of a document one after another: shuffled blocks compress far better
        one = np.flatnonzero(new)[~old]
        twice = again[~old]
        told = np.concatenate([told if len(told) < TOLD else told[:0], h[one[twice]]])
        order = np.argsort(d[one], kind="stable")
        one, twice = one[order], twice[order]
        slots = np.concatenate([h[one].view(np.int64), mix(keys[whose].view(np.uint64) ^ mix(ords[whose].view(np.uint64))).view(np.int64)])
        who = np.concatenate([d[one], whose])
        return pa.RecordBatch.from_arrays(
            [pa.array(slots), pa.array(ords[who]), pa.array(keys[who]), pa.array(np.concatenate([twice, np.zeros(len(whose), bool)])), pa.array([None] * len(one) + many, pa.binary())],
            ["slot", "ord", "key", "twice", "many"],
        )

    for batch in batches:
        for part in slices(batch, "_text"):
            ids, first = seen.rows(part)
            w = Windows(part.column("_text"), length)
            at, found = w.chosen(level, w.alive(first, before, part.column("repeated").to_pylist() if before else []))
            hashes.append(found)
            docs.append(ids[w.owner[at]])
            held += len(found)
            if held > GATHERED:
                yield from _portions(send())
                hashes, docs, seen, held = [], [], _Seen(), 0
    if held:
        yield from _portions(send())


#: `rest` has the hash's last 32 bits above the window's place, so rows stay short.
_WINDOW_ROWS = "h1 long, rest long, ord long, key long, many binary"


def _window_rows(batches: Iterator[pa.RecordBatch], length: int, before: int | None) -> Iterator[pa.RecordBatch]:
    """Windows of the full length. A row is a window's first place in this portion; or a
    document's list of places where windows have been earlier in this task."""
    gathered: list[tuple[np.ndarray, ...]] = []
    seen, held, told = _Seen(), 0, _Told()

    def send() -> pa.RecordBatch:
        h, d, at = (np.concatenate(x) for x in zip(*gathered))
        ords, keys = seen.identities()
        rank = np.empty(len(ords), np.int64)
        rank[np.lexsort((keys, ords))] = np.arange(len(ords))
        order = np.lexsort((at, rank[d], h[:, 1], h[:, 0]))
        h, d, at = h[order], d[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]).any(1)
        one = np.flatnonzero(new)
        again = np.diff(one, append=len(h)) > 1
        raw = h[one].tobytes()
        old = told.earlier([raw[k : k + 16] for k in range(0, len(raw), 16)], list(zip(ords[d[one]].tolist(), keys[d[one]].tolist())), again.tolist())
        later = ~new
        later[one[old]] = True
        whose, where = d[later], at[later]
        order = np.lexsort((where, whose))
        whose, many = _lists(whose[order], where[order].astype(np.int32))
        own = mix(keys[whose].view(np.uint64) ^ mix(ords[whose].view(np.uint64)))
        one = one[~old]
        one = one[np.lexsort((at[one], d[one]))]
        who = np.concatenate([d[one], whose])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([h[one, 0], own]).view(np.int64)), pa.array(np.concatenate([h[one, 1] << np.uint64(32) | at[one].astype(np.uint64), own]).view(np.int64)), pa.array(ords[who]), pa.array(keys[who]), pa.array([None] * len(one) + many, pa.binary())],
            ["h1", "rest", "ord", "key", "many"],
        )

    for batch in batches:
        for part in slices(batch, "_text"):
            ids, first = seen.rows(part)
            w = Windows(part.column("_text"), length)
            at = np.flatnonzero(w.alive(first, before, part.column("repeated").to_pylist() if before else []))
            gathered.append((w.digests(at), ids[w.owner[at]], at - w.first[w.owner[at]]))
            held += len(at)
            if held > GATHERED:
                yield from _portions(send())
                gathered, seen, held = [], _Seen(), 0
    if held:
        yield from _portions(send())


def _keep(batches: Iterator[pa.RecordBatch], length: int, keep: tuple[str, ...], as_is: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text"):
            texts, lists = part.column("_text").cast(pa.binary()).to_pylist(), part.column("removed").to_pylist()
            total, gone, kept = [], [], []
            for text, at in zip(texts, lists):
                words = text.split()
                total.append(len(words))
                if not at:
                    gone.append(0)
                    kept.append(text if as_is else b" ".join(words))
                    continue
                starts = np.unique(np.frombuffer(b"".join(at), np.int32))
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + length, -1)
                covered = np.cumsum(edge)[:-1] > 0
                gone.append(int(covered.sum()))
                kept.append(b" ".join([w for w, c in zip(words, covered.tolist()) if not c]))
            yield pa.RecordBatch.from_arrays([part.column("id"), *(part.column(c) for c in keep), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", *keep, "n_words", "n_removed", "kept"])


def dedup_substrings(df: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """(id, columns of `keep`, n_words long, n_removed long, kept string) of every row.

    Removes the words of every window of `length` words that also starts earlier:
    in a document of smaller id, or further up in the same one; windows are
    judged on the input. Kept words are joined by one space; with `as_is` a
    text that loses nothing stays as it is. Null texts have no words; a very long text
    is a portion of its own, like any other; a null id counts as the smallest; rows of
    one id are ordered by a hash of the text, those of one id and one text are one
    document and share a result; other columns are left out; an empty table gives no rows.
    """
    if length < 2:
        raise ValueError("a window has two words at least")
    docs = df.select(*_identity(id_col, text_col, keep))
    # every join takes the documents in the same form, so that their exchange is made once
    columns = ["id", *keep, "ord", "key", "_text"]
    alive, before = docs, None
    for level in levels(length)[:-1]:
        anchors = alive.mapInArrow(lambda it, level=level, before=before: _anchor_rows(it, length, level, before), _ANCHOR_ROWS)
        slot = Window.partitionBy("slot")
        anchors = anchors.withColumn("n", F.count("*").over(slot)).withColumn("any", F.max("twice").over(slot))
        known = anchors.filter(F.col("many").isNotNull() | (~F.col("twice") & ((F.col("n") > 1) | F.col("any"))))
        known = known.select("ord", "key", F.coalesce("many", _reversed(F.col("slot"))).alias("many"))
        known = known.groupBy("ord", "key").agg(F.collect_list("many").alias("repeated"))
        alive, before = docs.join(known, ["ord", "key"]).select(*columns, "repeated"), level
    found = alive.mapInArrow(lambda it: _window_rows(it, length, before), _WINDOW_ROWS)
    # dealt by h1 alone; the rest of the hash is unpacked where it is needed
    found = found.repartition("h1").withColumn("h2", F.shiftright("rest", 32)).withColumn("at", F.col("rest").bitwiseAND(F.lit((1 << 32) - 1)))
    first = F.min(F.struct("ord", "key")).over(Window.partitionBy("h1", "h2"))
    later = found.withColumn("first", first).filter(F.col("many").isNotNull() | (F.col("first") < F.struct("ord", "key")))
    later = later.select("ord", "key", F.coalesce("many", _reversed(F.col("at"), 4)).alias("many")).groupBy("ord", "key").agg(F.collect_list("many").alias("removed"))
    out = docs.join(later, ["ord", "key"], "left").select(*columns, "removed")
    kind = df.schema[id_col].dataType.simpleString()
    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return out.mapInArrow(lambda it: _keep(it, length, keep, as_is), f"id {kind}{kept}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def _reversed(number: F.Column, size: int = 8) -> F.Column:
    """The number's bytes, least significant first."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(size))))
