"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Leaves hold rank << 32 | position of the pair that starts there, inner nodes the
least key below them, so the root is the leftmost pair of the lowest rank. A
merge changes three leaves at most; each is carried up in logarithmic time.
Short pieces go through one tree each, many at a time, as rows of an array; long
ones through a tree of their own. New words are cut, merged and decoded together, as
arrays of code points, symbols and places.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_text

NONE = np.int64(1 << 62)
#: Pieces of up to so many symbols share an array of trees; bits of a place in these,
#: and leaves of one such array.
SHORT, PLACE, ROOM = 64, 7, 1 << 16
#: Bytes of a worker's cache of words, in each of two generations, and what an entry
#: takes besides its strings. One portion of text may go beyond.
WORD_BYTES, ENTRY_BYTES = 48 << 20, 250
#: Bytes of text that a worker encodes at a time.
PORTION = 2 << 20
#: Tokens that are turned into text at a time.
DECODED = 1 << 18


class Kept:
    """A cache of ids, and of texts where given, in two generations: when the newer is full
    it becomes the older, whose entries come back as they are asked for and are forgotten
    otherwise."""

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.ids: dict = {}
        self.texts: dict = {}
        self.older = self.ids, self.texts

    def put(self, key: str | bytes | int, ids: bytes, text: bytes = b"") -> None:
        self.ids[key] = ids
        if text:
            self.texts[key] = text
        self.held += ENTRY_BYTES + len(ids) + len(key) + 2 * len(text)

    def missing(self, keys: Iterable) -> list:
        """Those of a portion's distinct keys that have to be made; the others are kept."""
        if self.held > self.most:
            self.older, self.ids, self.texts, self.held = (self.ids, self.texts), {}, {}, 0
        (old, old_texts), out = self.older, []
        for k in itertools.filterfalse(self.ids.__contains__, keys):
            if (ids := old.get(k)) is None:
                out.append(k)
            else:
                self.put(k, ids, old_texts.get(k, b""))
        return out


PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Code points that may be plain: the normaliser joins none of them with a neighbour.
PLAIN = (*range(0x21, 0x7F), *range(0xA1, 0x250))
#: Classes of plain characters after lower-casing; any other character is ODD.
LETTER, NUMBER, OTHER, BREAK, ODD = range(5)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes
    stand for themselves, the others are numbered from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs: starts[0], starts[0] + 1, ... for each run, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Encoder:
    """Encodes as the vocabulary file's own library does, without begin, end or
    added special tokens; special strings inside a text get their own ids.

    Texts are cut at ASCII white space, which the file's normaliser and
    pre-tokeniser never join over, and every distinct word is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or model["continuing_subword_prefix"] or model["ignore_merges"]:
            raise ValueError("only plain BPE vocabularies are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        if steps != (["NFC", "Replace", "Lowercase"], PATTERN):
            raise ValueError("only this way of cutting words is supported")
        specials = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in specials):
            raise ValueError("added tokens must be plain strings without white space")
        self.special = {t["content"]: t["id"] for t in specials}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if specials else None
        self.strings: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made  # made is by rank
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))
        letters = byte_letters()
        self.byte_of = {ord(c): b for c, b in letters.items()}
        letter_of = {b: c for c, b in letters.items()}
        self.inner = np.array([self.vocab.get(letter_of[b], -1) for b in range(256)], np.int64)
        self.outer = np.array([self.vocab.get(letter_of[b] + self.suffix, -1) for b in range(256)], np.int64)
        # token strings side by side, each with the space that joins it to the next
        texts = [(self.strings[i] + " ").encode("utf-8") if i in self.strings else b"" for i in range(max(self.strings) + 1)]
        self.letters = np.frombuffer(b"".join(texts), np.uint8)
        self.letters_at = np.cumsum([0, *map(len, texts)])
        self._plain_rules()

    def _plain_rules(self) -> None:
        """The characters that the library lower-cases as Python does, and how it classes
        them: tables of code points are far faster than its own calls."""
        low = {cp: self.library.normalizer.normalize_str(chr(cp)) for cp in PLAIN}
        plain = [cp for cp in PLAIN if low[cp] == chr(cp).lower() and ord(low[cp][0]) in low and len(low[cp]) == 1]
        parts = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text))
        results = sorted({low[cp] for cp in plain})
        kind = {c: LETTER if parts("a" + c) == 1 else NUMBER if parts(c + c) == 2 else OTHER for c in results}
        self.kind, self.low = np.full(0x251, ODD, np.uint8), np.arange(0x251, dtype="<u4")
        self.kind[ord("\n")] = BREAK
        for cp in plain:
            self.kind[cp], self.low[cp] = kind[low[cp]], ord(low[cp])

    # -- one pair, many pairs -------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' ranks; -1 where they don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_many(self, pieces: list[list[int]]) -> list[list[int]]:
        """Merged symbols of each piece."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids, sizes = self.merge_flat(np.fromiter(itertools.chain.from_iterable(pieces), np.int64, int(sizes.sum())), sizes)
        ids, ends = ids.tolist(), np.cumsum(sizes).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merge_flat(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of pieces that lie side by side, and their numbers."""
        starts, low = np.cumsum(sizes) - sizes, 1
        found = [(rows := np.flatnonzero(sizes == 1), symbols[starts[rows]], sizes[rows])]
        for high in (2, 4, 8, 16, 32, SHORT):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            step = ROOM // high  # so that an array of trees stays in the processor's cache
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                found.append((part, *self._merge_rows(symbols, starts[part], sizes[part], high)))
        for i in np.flatnonzero(sizes > SHORT).tolist():
            ids = self.merge_one(symbols[starts[i] : starts[i] + sizes[i]].tolist())
            found.append((np.array([i]), np.array(ids, np.int64), np.array([len(ids)])))
        merged = np.zeros_like(sizes)
        for rows, _, n in found:
            merged[rows] = n
        begin, out = np.cumsum(merged) - merged, np.empty(int(merged.sum()), np.int64)
        for rows, ids, n in found:
            out[_spread(begin[rows], n)] = ids
        return out, merged

    def _merge_rows(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A row of symbols and a tree of `width` leaves for each piece, all in flat arrays."""
        n, none = len(sizes), np.int32(1 << 30)
        sym = np.full((n, width + 1), -1, np.int64)
        inside = np.arange(width + 1) < sizes[:, None]
        sym[inside] = symbols[_spread(starts, sizes)]
        nxt = np.tile(np.arange(1, width + 2), n)
        prv = np.tile(np.arange(-1, width), n)
        tree = np.full((n, 2 * width), none, np.int32)
        pair = inside[:, 1:]
        rank = self._rank(sym[:, :-1][pair], sym[:, 1:][pair])
        tree[:, width:][pair] = np.where(rank >= 0, rank << PLACE | np.broadcast_to(np.arange(width), (n, width))[pair], none)
        span = width
        while span > 1:
            tree[:, span // 2 : span] = np.minimum(tree[:, span : 2 * span : 2], tree[:, span + 1 : 2 * span : 2])
            span //= 2
        sym, tree = sym.ravel(), tree.ravel()

        def key(at: np.ndarray, i: np.ndarray, j: np.ndarray, ends: np.ndarray) -> np.ndarray:
            rank = self._rank(sym[at + i], sym[at + j])
            return np.where((j < ends) & (rank >= 0), rank << PLACE | i, none)

        rows = np.flatnonzero(tree[1 :: 2 * width] < none)
        while len(rows):
            at, up, ends = rows * (width + 1), rows * (2 * width), sizes[rows]
            root = tree[up + 1].astype(np.int64)
            i, rank = root & (1 << PLACE) - 1, root >> PLACE
            j = nxt[at + i]
            sym[at + i], sym[at + j] = self.made[rank], -1
            k = nxt[at + j]
            nxt[at + i] = k
            k = np.minimum(k, width)
            prv[at + k] = i
            h = prv[at + i]
            left = h >= 0
            some = up[left]
            # three leaves change; every level above is brought up to date at once
            node = np.concatenate([j, i, h[left]]) + width
            tree_of = np.concatenate([up, up, some])
            leaf = np.concatenate([np.full(len(rows), none), key(at, i, k, ends), key(at[left], h[left], i[left], ends[left])])
            within = node < 2 * width  # the last symbol of a full row starts no pair
            node, tree_of = node[within], tree_of[within]
            tree[tree_of + node] = leaf[within]
            for _ in range(width.bit_length() - 1):
                node >>= 1
                child = tree_of + 2 * node
                tree[tree_of + node] = np.minimum(tree[child], tree[child + 1])
            rows = rows[tree[up + 1] < none]
        sym = sym.reshape(n, width + 1)
        keep = sym >= 0
        return sym[keep], keep.sum(1)

    def merge_one(self, symbols: list[int]) -> list[int]:
        """Merged symbols of one piece of any length."""
        n, rank_of, made, none = len(symbols), self.rank_of, self.made, int(NONE)
        sym, width = list(symbols), 1 << max(1, (n - 1).bit_length())
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = rank_of.get(sym[i] << 32 | sym[i + 1])
            if rank is not None:
                tree[width + i] = rank << 32 | i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low

        def key(i: int, j: int) -> int:
            rank = rank_of.get(sym[i] << 32 | sym[j]) if j < n else None
            return none if rank is None else rank << 32 | i

        while tree[1] < none:
            i, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            j = nxt[i]
            sym[i], sym[j] = int(made[rank]), -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
            put(j, none)
            put(i, key(i, k))
            if prv[i] >= 0:
                put(prv[i], key(prv[i], i))
        return [s for s in sym if s >= 0]

    # -- words ----------------------------------------------------------------

    def _other_pieces(self, word: str) -> Iterator[str | int]:
        parts = self.special_pattern.split(word) if self.special_pattern else [word]
        for part in parts:
            if part in self.special:
                yield self.special[part]
            elif part:
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    yield bytes(map(self.byte_of.__getitem__, map(ord, piece))).decode("utf-8")

    def _symbols(self, piece: str) -> list[int]:
        raw = np.frombuffer(piece.encode("utf-8"), np.uint8)
        ids = self.inner[raw]
        ids[-1:] = self.outer[raw[-1:]]
        return ids[ids >= 0].tolist()

    def _other_words(self, words: list[str]) -> list[list[int]]:
        """Symbols of words that need the library's own normaliser and pre-tokeniser."""
        plans = [list(self._other_pieces(w)) for w in words]
        pieces = list(dict.fromkeys(p for p in itertools.chain.from_iterable(plans) if isinstance(p, str)))
        ids = dict(zip(pieces, self.merge_many([self._symbols(p) for p in pieces])))
        return [list(itertools.chain.from_iterable(ids[p] if isinstance(p, str) else [p] for p in plan)) for plan in plans]

    def code_words(self, words: list[bytes]) -> list[bytes]:
        """Of each word, which has no ASCII white space, the ids as little-endian
        unsigned 32-bit integers."""
        if not words:
            return []
        text = b"\n".join([*words, b""]).decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        near = np.minimum(points, len(self.kind) - 1)
        kind = self.kind[near]
        breaks = np.flatnonzero(kind == BREAK)
        odd = [np.searchsorted(breaks, np.flatnonzero(kind == ODD))]
        if self.special_pattern:
            odd.append(np.searchsorted(breaks, [m.start() for m in self.special_pattern.finditer(text)]))
        odd = np.unique(np.concatenate(odd).astype(np.int64))
        low = self.low[near]
        # a piece begins where the class changes, and with every number
        first = np.ones(len(kind), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        self._contract(low, kind, first)
        # odd words have no pieces here
        of_word = np.cumsum(kind == BREAK) - (kind == BREAK)
        inside = kind != BREAK
        if len(odd):
            mark = np.zeros(len(words), bool)
            mark[odd] = True
            inside &= ~mark[of_word]
        begin = np.flatnonzero(first & inside)
        low, size = low[inside], np.cumsum(first[inside])
        raw = low.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
        # bytes of each piece: its characters, and one more for each that takes two
        lengths = np.bincount(size - 1, 1 + (low >= 0x80), len(begin)).astype(np.int64)
        ends = np.cumsum(lengths)
        pieces, cuts = {}, ends.tolist()
        place = np.fromiter((pieces.setdefault(raw[a:b], len(pieces)) for a, b in zip([0, *cuts], cuts)), np.int64, len(cuts))
        distinct = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols, last = self.inner[distinct], np.cumsum(sizes) - 1
        symbols[last] = self.outer[distinct[last]]
        if len(symbols) and symbols.min() < 0:
            known = symbols >= 0
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), known, len(sizes)).astype(np.int64)
            symbols = symbols[known]
        merged, n = self.merge_flat(symbols, sizes)
        ids = merged[_spread((np.cumsum(n) - n)[place], n[place])]
        per_word = np.bincount(of_word[begin], n[place], len(words)).astype(np.int64)
        flat, at = ids.astype("<u4").tobytes(), (4 * np.cumsum(per_word)).tolist()
        out = [flat[a:b] for a, b in zip([0, *at], at)]
        for i, own in zip(odd.tolist(), self._other_words([words[i].decode("utf-8") for i in odd.tolist()])):
            out[i] = np.array(own, "<u4").tobytes()
        return out

    def _contract(self, low: np.ndarray, kind: np.ndarray, first: np.ndarray) -> None:
        """Sets the pieces of contractions: their apostrophe begins a piece."""
        at = np.flatnonzero((low == ord("'")) & first)
        for form in CONTRACTIONS:
            own = at[at + len(form) < len(low)]  # a break is last
            for k, c in enumerate(form):
                own = own[low[own + k] == ord(c)]
            first[own + 1] = False
            first[own + len(form)] = True

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        return [np.frombuffer(ids, "<u4").tolist() for ids in self.code_words(words)]

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: token strings, joined by one space."""
        return " ".join(self.strings[i] for i in ids)

    def decode_many(self, coded: list[bytes]) -> Iterator[bytes]:
        """decode() in UTF-8 of each run of ids, all together: the token strings' letters
        are gathered, DECODED tokens at a time."""
        ids = np.frombuffer(b"".join(coded), "<u4")
        sizes = self.letters_at[1:] - self.letters_at[:-1]
        parts = []
        for i in range(0, len(ids), DECODED):
            some = ids[i : i + DECODED]
            parts.append(self.letters[_spread(self.letters_at[some], sizes[some])].tobytes())
        text = b"".join(parts)
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum([0, *(len(c) // 4 for c in coded)])].tolist()
        for a, b in zip(ends, ends[1:]):
            yield text[a : b - 1] if b > a else b""  # without the space behind the last


_ENCODERS: dict[str, Encoder] = {}
_WORDS: dict[str, Kept] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(texts: list[bytes], path: str) -> Iterator[tuple[bytes, bytes]]:
    """For each text its ids as little-endian unsigned 32-bit integers and the
    decoded text in UTF-8. Words that are not in the worker's cache are encoded
    together first."""
    enc, kept = encoder(path), _WORDS.setdefault(path, Kept(WORD_BYTES))
    split = [t.split() for t in texts]
    new = kept.missing(set().union(*split))
    for word, ids in zip(new, enc.code_words(new)):
        kept.put(word, ids)
    coded = [b"".join(map(kept.ids.__getitem__, words)) for words in split]
    return zip(coded, enc.decode_many(coded))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary, decoded string) of every whole text.

    `ids` are little-endian unsigned 32-bit integers. One pass, no shuffle.
    Null and empty texts give no ids and an empty decoded text; a very long text is
    a portion of its own; repeated rows give repeated rows; null ids stay null; an
    empty table gives no rows; other columns are left out.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", PORTION):
                texts = part.column("_text").cast(pa.binary()).to_pylist()
                both = list(encode_texts(texts, path))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array([len(a) // 4 for a, _ in both], pa.int64()), pa.array([a for a, _ in both], pa.binary()), pa.array([b for _, b in both], pa.binary()).cast(pa.string())],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    rows = df.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)
