"""What the operators are held to: the same results, one row at a time."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def words(text):
    return (text or "").encode().split()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < k else [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows):
    """rows: (doc_id, text), ids not null."""
    prints = [(d, fingerprint(t)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, x) in enumerate(prints):
        for b, y in prints[i + 1 :]:
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {(d, f"{x:016x}", root(d)) for d, x in prints}


def substrings(rows, length=20):
    """rows: (doc_id, text) without repeats, in order of documents."""
    seen, out = set(), {}
    for d, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                gone[i : i + length] = [True] * length
            seen.add(key)
        out[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def unigram(rows, folds=7, held=2):
    training = [words((t or "").lower() if (t or "").isascii() else t) for d, t in rows]
    count, ends = Counter(), 0
    fold = lambda d: zlib.crc32(str("" if d is None else d).encode()) % folds
    low = [[w.lower() for w in ws] for ws in training]
    for (d, _), ws in zip(rows, low):
        if fold(d) != held:
            count.update(ws)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    return [(d, fold(d) == held, len(ws) + 1, sum(count[w] > 0 for w in ws) + (ends > 0), n, sum(log(count[w]) for w in ws) + log(ends)) for (d, _), ws in zip(rows, low)]


def warc(rows):
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(page, last.get(html or "", page))
    out = {}
    for page, _, html in rows:
        data, head = (html or "").encode(), last[html or ""]
        out[page] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if head == page else "revisit", None if head == page else head)
    return out
