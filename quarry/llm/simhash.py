"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated bits are grouped into parts; a dynamic programme gives each part a
threshold of its own, so that the estimated number of candidates is least while
the thresholds still add up to the guarantee. Texts that agree in a part up to
its threshold meet in a bucket and are verified there.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, maybe_among, mix, release, slices, whole_text

#: Members up to which all pairs of a bucket are verified in one go.
BUCKET = 64
#: Distinct shingles of a text up to which its near copies are found on the shingles.
FEW = 50
#: Members of a block, where larger buckets are compared block by block.
BLOCK = 1024
#: Pairs whose fingerprints are compared at a time.
COMPARED = 1 << 17
#: Fingerprints of which a task sums up one matrix of bits.
ROWS_OF_A_MATRIX = 20_000
#: Where not all pairs are guaranteed: bits of a part at least, and the share of pairs at the
#: usual distance that meet in some part.
PART_BITS, RECALL = 13, 0.99

# -- fingerprints ----------------------------------------------------------------

_BYTE_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).copy().view(np.uint64).ravel()


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text whose A-Z are lower-cased, with
    repeats; of the whole sequence if it has fewer words; none without words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, h = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(line, 42)], np.uint64)
    ends = list(itertools.accumulate(len(p) + 1 for p in parts))
    return np.fromiter((h(line[a : b - 1], 42) for a, b in zip([0, *ends], ends[words - 1 :])), np.uint64, len(parts) - words + 1)


def majority_bits(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of bits / 8 bytes for each text: the bits that over half its hashes
    have. Beyond 64 bits the hashes are mixed anew, once for every 64."""
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros((len(hashes), bits // 8), np.uint8)
    have = np.flatnonzero(sizes)
    if not len(have):
        return out
    every = np.concatenate([hashes[i] for i in have])
    starts = np.concatenate([[0], np.cumsum(sizes[have])[:-1]])
    # counters of 8 bits lie side by side in 64: no more than 255 rows go into one sum
    pieces = -(-sizes[have] // 255)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    owner = np.repeat(np.arange(len(have)), pieces)
    ends = np.append(cuts[1:], len(every))
    for lane in range(bits // 64):
        counts = np.zeros((len(have), 64), np.int64)
        for i in range(0, len(cuts), 1024):
            j = min(i + 1024, len(cuts))
            h = every[cuts[i] : ends[j - 1]]
            if lane:
                h = mix(h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            rows = _BYTE_COUNTERS[h.astype(">u8").view(np.uint8).reshape(-1, 8)]
            sums = np.add.reduceat(rows, cuts[i:j] - cuts[i], 0).view(np.uint8).reshape(-1, 64)
            new = np.flatnonzero(np.diff(owner[i:j], prepend=-1))
            counts[owner[i:j][new]] += np.add.reduceat(sums, new, 0, np.int64)
        out[have, lane * 8 : lane * 8 + 8] = np.packbits(2 * counts > sizes[have][:, None], axis=1)
    return out


def fingerprints(df: DataFrame, words: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """(id, fingerprint binary) of every whole text; one pass, no shuffle. With
    `distinct` of its distinct shingles, and (few binary) these, if FEW at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                hashes = [shingle_hashes(t, words) for t in part.column("_text").cast(pa.binary()).to_pylist()]
                if distinct:
                    hashes = [np.unique(h) for h in hashes]
                found = {"id": part.column("_id"), "fingerprint": pa.array([r.tobytes() for r in majority_bits(hashes, bits)], pa.binary())}
                if distinct:
                    found["few"] = pa.array([h.tobytes() if 0 < len(h) <= FEW else None for h in hashes], pa.binary())
                yield pa.RecordBatch.from_pydict(found)

    rows = df.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kind = f"id {df.schema[id_col].dataType.simpleString()}, fingerprint binary" + (", few binary" if distinct else "")
    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1 if values else 8)


# -- the plan ----------------------------------------------------------------------


@dataclass
class Plan:
    """Bits of each part and its threshold (-1: the part is not probed)."""

    parts: list[list[int]]
    thresholds: list[int]


def bit_correlation(prints: DataFrame, bits: int, n: int) -> np.ndarray:
    """Absolute correlation of all pairs of bits, over all fingerprints. A task's sums
    are one matrix, so a task takes many rows; matrices are added up row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bits, bits))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = np.unpackbits(_matrix(batch.column(0).slice(at, 4096)), axis=1).astype(np.float32)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(bits), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["bit", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(r, np.float64) for r in rows.sums], axis=0)
        return pd.DataFrame({"bit": rows.bit.iloc[:1], "sums": [total.tobytes()]})

    parts = prints.select("fingerprint").coalesce(max(1, n // ROWS_OF_A_MATRIX)).mapInArrow(run, "bit int, sums binary")
    both = np.zeros((bits, bits))
    for r in parts.groupBy("bit").applyInPandas(add, "bit int, sums binary").collect():
        both[r.bit] = np.frombuffer(r.sums, np.float64)
    n = max(n, 1)
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal size; each grows by the bit that is most
    correlated with those it has."""
    bits = len(correlation)
    free, parts = set(range(bits)), []
    for k in range(m):
        size = bits // m + (k < bits % m)
        order = sorted(free)
        seed = max(order, key=lambda b: (correlation[b, order].sum(), -b))
        part = [seed]
        free.discard(seed)
        weight = correlation[seed].copy()
        while len(part) < size:
            best = max(sorted(free), key=lambda b: weight[b])
            part.append(best)
            free.discard(best)
            weight += correlation[best]
        parts.append(sorted(part))
    return parts


def allocate(sizes: list[int], same: list[float], n: int, tau: int, most: int = 2) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum(t + 1) = tau + 1. `same`: the chance that
    two fingerprints agree in a part. Costs are candidate pairs and bucket rows."""

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        near = min(1.0, same[i] * sum(math.comb(sizes[i], k) for k in range(t + 1)))
        return n * (n - 1) / 2 * near + 4.0 * n * math.comb(sizes[i], t)

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(sizes)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(-1, most + 1):
                u = used + t + 1
                if u <= tau + 1 and (u not in step or c + cost(i, t) < step[u][0]):
                    step[u] = (c + cost(i, t), [*chosen, t])
        best = step
    return best.get(tau + 1, (math.inf, []))


def layouts_for(n: int, bits: int, usual: int) -> tuple[int, int]:
    """Parts of a layout, and layouts. Parts are so wide that n fingerprints without
    copies fill a bucket with BUCKET of them at the utmost, and as many that a pair
    `usual` bits apart agrees in one of them with a chance of RECALL."""
    width = min(bits, max(PART_BITS, math.ceil(math.log2(max(1, n) / BUCKET))))
    agree = math.prod((bits - usual - i) / (bits - i) for i in range(width))
    return bits // width, math.ceil(math.log(1 - RECALL) / math.log1p(-agree) / (bits // width))


def wide_plan(prints: DataFrame, bits: int, usual: int) -> Plan:
    """Parts in which fingerprints must agree: those of the first layout hold correlated
    bits together, as far as there are more, they are dealt at random."""
    n = prints.count()
    m, layouts = layouts_for(n, bits, usual)
    parts = group_bits(bit_correlation(prints, bits, n), m)
    thresholds = allocate([len(p) for p in parts], [2.0 ** -len(p) for p in parts], n, m - 1)[1]
    for k in range(1, layouts):
        order = np.random.default_rng(k).permutation(bits)
        parts += [sorted(p.tolist()) for p in np.array_split(order, m)]
    return Plan(parts, thresholds + [0] * (len(parts) - m))


def _part_keys(x: np.ndarray, part: list[int], drop: tuple[int, ...] = ()) -> np.ndarray:
    """Of rows of bits the bits of a part, as numbers."""
    own = x[:, [b for k, b in enumerate(part) if k not in drop]].astype(np.int64)
    return own @ (np.int64(1) << np.arange(own.shape[1]))


def make_plan(prints: DataFrame, bits: int, tau: int, choices: tuple[int, ...]) -> Plan:
    """Tries each number of parts; how often two fingerprints agree in a part is
    measured over all of them."""
    n = prints.count()
    correlation = bit_correlation(prints, bits, n)
    layouts = {m: group_bits(correlation, m) for m in choices}
    tags = [(m, k) for m in choices for k in range(m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.unpackbits(_matrix(batch.column(0)), axis=1)
            for tag, (m, k) in enumerate(tags):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tag, np.int32)), pa.array(_part_keys(x, layouts[m][k]))], ["tag", "key"])

    sizes = prints.select("fingerprint").mapInArrow(run, "tag int, key long").groupBy("tag", "key").count()
    squares = {r.tag: r.s for r in sizes.groupBy("tag").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s")).collect()}
    plans = []
    for m in choices:
        widths = [len(p) for p in layouts[m]]
        same = [max(0.0, squares.get(tags.index((m, k)), 0.0) - n) / max(1.0, n * (n - 1.0)) for k in range(m)]
        # at least what chance gives, so that few rows don't make a short part look selective
        same = [max(s, 2.0**-w) for s, w in zip(same, widths)]
        cost, thresholds = allocate(widths, same, n, tau)
        plans.append((cost, m, thresholds))
    _, m, thresholds = min(plans)
    return Plan(layouts[m], thresholds)


# -- candidates and links --------------------------------------------------------------


def bucket_bits(plan: Plan) -> list[tuple[list[int], tuple[int, ...]]]:
    """Of each kind of bucket the part, and the places in it that are left out."""
    return [(part, drop) for part, t in zip(plan.parts, plan.thresholds) if t >= 0 for drop in itertools.combinations(range(len(part)), t)]


def bucket_masks(plan: Plan) -> np.ndarray:
    """Of each kind of bucket the bits that its members agree in, a row of 64-bit lanes."""
    kinds, bits = bucket_bits(plan), len({b for p in plan.parts for b in p})
    out = np.zeros((len(kinds), bits), np.uint8)
    for k, (part, drop) in enumerate(kinds):
        out[k, [b for i, b in enumerate(part) if i not in drop]] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def buckets(prints: DataFrame, plan: Plan, whole: bool = True) -> DataFrame:
    """(part, key, node, and if `whole` the fingerprint's 64-bit lanes s0, ...): two rows
    within a part's threshold t share the bucket that leaves out the bits in which they
    differ, t of them."""
    kinds, bits = bucket_bits(plan), len({b for p in plan.parts for b in p})
    names = ["part", "key", "node", *(f"s{k}" for k in range(bits // 64 if whole else 0))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                rows = batch.slice(at, 8192)
                prints = _matrix(rows.column(1))
                own = [pa.array(prints[:, 8 * k : 8 * k + 8].copy().view(np.int64).ravel()) for k in range(len(names) - 3)]
                x = np.unpackbits(prints, axis=1)
                for tag, (part, drop) in enumerate(kinds):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tag, np.int32)), pa.array(_part_keys(x, part, drop)), rows.column(0), *own], names)

    return prints.select("node", "fingerprint").mapInArrow(run, "part int, " + ", ".join(f"{c} long" for c in names[1:]))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1)


def forest(n: int, a: Iterable[int], b: Iterable[int], tree: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Of the given links among n nodes those of a spanning forest; at its end `tree` has
    the root of each node."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(a, b):
        r, s = root(i), root(j)
        if r != s:
            up[r] = s
            yield i, j
    if tree is not None:
        tree[:] = [root(i) for i in range(n)]


def _earlier(x: np.ndarray, y: np.ndarray, tag: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether two fingerprints, which share a bucket of kind `tag`, share one of a lesser
    kind as well, where the pair is met first."""
    out = np.zeros(len(tag), bool)
    for at in range(0, len(tag), COMPARED // 16):
        part, differ = tag[at : at + COMPARED // 16], x[at : at + COMPARED // 16] ^ y[at : at + COMPARED // 16]
        for k in range(int(part.max(initial=0))):
            out[at : at + len(part)] |= (k < part) & ~(differ & masks[k]).any(1)
    return out


def _verify(batches: Iterator[pa.RecordBatch], sure: int, tau: int, masks: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Pairs of near fingerprints within buckets of at most BUCKET members, with their
    distance, all buckets of a size together. Pairs up to `sure` bits are links: of a crowded
    bucket a spanning forest of these is kept, and of the others those between its
    trees. With `masks` a pair is left to the first bucket that it shares."""
    for batch in batches:
        nodes, part = batch.column(1), batch.column(0).to_numpy()
        sizes = nodes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        node = nodes.flatten().to_numpy(zero_copy_only=False)
        x = np.stack([batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(2, batch.num_columns)], 1).view(np.uint64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for s in np.unique(sizes).tolist():
            i, j = np.triu_indices(s, 1)
            every = np.flatnonzero(sizes == s)
            step = max(1, COMPARED // max(1, len(i)))
            for k in range(0, len(every), step):
                at = first[every[k : k + step]]
                p, q = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                d = _distances(x[p], x[q])
                near = np.flatnonzero(d <= tau)
                p, q, d, own = p[near], q[near], d[near], near // max(1, len(i))
                if masks is not None:
                    new = ~_earlier(x[p], x[q], part[every[k : k + step]][own], masks)
                    p, q, d, own = p[new], q[new], d[new], own[new]
                crowded = (np.bincount(own[d <= sure], minlength=len(at)) > 3 * s)[own]
                if crowded.any():
                    firm = crowded & (d <= sure)
                    tree, keep = np.arange(len(x)), ~crowded
                    kept = set(forest(len(x), p[firm].tolist(), q[firm].tolist(), tree))
                    keep[firm] = [r in kept for r in zip(p[firm].tolist(), q[firm].tolist())]
                    keep |= crowded & (d > sure) & (tree[p] != tree[q])
                    p, q, d = p[keep], q[keep], d[keep]
                if len(p):
                    low, high = np.minimum(node[p], node[q]), np.maximum(node[p], node[q])
                    yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(d.astype(np.int32))], ["a", "b", "apart"])


def _flips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint and its neighbours at one bit."""
    flip = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            rows = batch.slice(at, 8192)
            x = rows.column(1).to_numpy().view(np.uint64)[:, None]
            z = (x ^ flip).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.repeat(rows.column(0).to_numpy(), 65))], ["z", "node"])


def _blocks(batches: Iterator[pa.RecordBatch], sure: int, tau: int, turn: int | None, masks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Links within and between two blocks of a bucket, with their distance, between nodes
    of different trees, as given: a forest of those of `sure` bits or fewer, then of the
    others a forest as well, by the nearest partner of a tree (turn 0) or one by
    chance; with no turn all of them. A row at a time, so memory is one block. With
    `masks` a pair is left to the first bucket that it shares."""
    names = ["a", "b", "apart", "part", "key"]
    for batch in batches:
        for at in range(batch.num_rows):
            part, key, left, lx, lt, right, rx, rt = (c[0].as_py() for c in batch.slice(at, 1).columns)
            node, n = np.array(left + right), len(left)
            x = np.frombuffer(b"".join(lx + rx), np.uint64).reshape(len(node), -1)
            tree = np.unique(np.array(lt + rt), return_inverse=True)[1]
            held, many = [], 0
            rows = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)  # noqa: E731, B023
            for low, high in ((-1, sure), (sure, tau)):
                for i in range(n):
                    start = n if right else i + 1
                    others = np.flatnonzero(tree[start:] != tree[i]) + start
                    d = _distances(x[i], x[others])
                    near = (d > low) & (d <= high)
                    others, d = others[near], d[near].astype(np.int32)
                    if masks is not None and part and len(others):
                        new = ~_earlier(np.broadcast_to(x[i], (len(others), x.shape[1])), x[others], np.full(len(others), part), masks)
                        others, d = others[new], d[new]
                    if not len(others):
                        continue
                    if low < 0 or turn is not None:
                        order = np.argsort(mix(others.astype(np.uint64) * np.uint64(n) + np.uint64(i)) if turn and low >= 0 else d, kind="stable")
                        first = order[np.unique(tree[others[order]], return_index=True)[1]]
                        others, d = others[first], d[first]
                        tree[np.isin(tree, tree[others])] = tree[i]
                    held.append((np.full(len(others), node[i]), node[others], d, np.full(len(others), part, np.int32), np.full(len(others), key)))
                    if (many := many + len(others)) >= 50_000:
                        yield rows()
                        held.clear()
                        many = 0
            if held:
                yield rows()


def _dealt(rows: DataFrame, keys: list[str], values: list[str], named: tuple[str, ...] = ()) -> DataFrame:
    """(the keys `named`, left lists, right lists): nodes and values of all pairs of blocks of the buckets that
    `keys` name, the right ones empty where a block meets itself. `rows`: keys, node, values, size."""
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("n_blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("node", keys[0]), F.col("n_blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    pairs = pairs.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node", *values)
    lists = [F.collect_list(F.when(F.col("second") if side else ~F.col("second"), F.col(v))).alias(f"l{side}{k}") for side in (0, 1) for k, v in enumerate(["node", *values])]
    grouped = pairs.groupBy(*keys, "i", "j").agg(*lists)
    return grouped.filter((F.col("i") == F.col("j")) | (F.size("l10") > 0)).select(*named, *(f"l{side}{k}" for side in (0, 1) for k in range(len(values) + 1)))


def bucket_sizes(prints: DataFrame, plan: Plan) -> DataFrame:
    """(part, key, size) of the buckets with several members."""
    return cut(buckets(prints, plan, False).groupBy("part", "key").agg(F.count("*").alias("size")).filter("size > 1"))


def shared_buckets(prints: DataFrame, plan: Plan, sizes: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """Rows of buckets() whose bucket is among those of `sizes`, all that have several
    members if not given, with its size."""
    return buckets(prints, plan, whole).join(bucket_sizes(prints, plan) if sizes is None else sizes, ["part", "key"])


def small_links(shared: DataFrame, prints: DataFrame, bits: int, tau: int, sure: int | None = None, masks: np.ndarray | None = None) -> DataFrame:
    """Links (a, b, apart) of the buckets of up to BUCKET members; of those up to `sure` bits
    (all, if not given) as many as have the same components."""
    lanes = [f"s{k}" for k in range(bits // 64)]
    small = shared.filter(F.col("size") <= BUCKET).groupBy("part", "key").agg(F.collect_list(F.struct("node", *lanes)).alias("m"))
    return small.select("part", "m.node", *(f"m.{c}" for c in lanes)).mapInArrow(lambda it: _verify(it, tau if sure is None else sure, tau, masks), "a long, b long, apart int")


def block_links(hot: DataFrame, prints: DataFrame, trees: DataFrame, sure: int, tau: int, turn: int | None, masks: np.ndarray | None = None) -> DataFrame:
    """Links (a, b, apart, part, key) between different trees (node, component) in the buckets
    `hot`, which are compared block by block; buckets of one tree are left out. Trees and
    fingerprints come to a node once, whatever the number of its buckets."""
    nodes = hot.groupBy("node").agg(F.collect_list(F.struct("part", "key", "size")).alias("at"))
    nodes = cut(nodes.join(trees, "node", "left").join(prints.select("node", "fingerprint"), "node").select("node", "fingerprint", F.coalesce("component", "node").alias("tree"), "at"))
    rows = nodes.select("node", "fingerprint", "tree", F.inline("at"))
    mixed = rows.groupBy("part", "key").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).filter("lo <> hi").select("part", "key")
    dealt = _dealt(rows.join(mixed, ["part", "key"]), ["part", "key"], ["fingerprint", "tree"], ("part", "key"))
    return dealt.mapInArrow(lambda it: _blocks(it, sure, tau, turn, masks), "a long, b long, apart int, part int, key long")


def near_links(prints: DataFrame, bits: int, tau: int, choices: tuple[int, ...] | None = None) -> DataFrame:
    """Links (a, b, apart) whose connected components are those of all pairs that differ in
    `tau` bits or fewer. `prints`: (node long, fingerprint binary), fingerprints distinct.

    Buckets over BUCKET members are handled without emitting their pairs. Up to
    two bits, by neighbours at one bit: two fingerprints within two bits share
    one, and at most 65 share any, so this is linear and has no hot key. Beyond,
    by pairs of blocks, each compared in one task, which gives a forest of the links.
    """
    shared = cut(shared_buckets(prints, make_plan(prints, bits, tau, choices or tuple(range(2, tau + 3)))))
    links, hot = small_links(shared, prints, bits, tau), shared.filter(F.col("size") > BUCKET)
    if not hot.take(1):
        return links
    if bits == 64 and tau <= 2:
        if tau < 2:
            raise ValueError("neighbours at one bit give all links within two bits")
        shared_by = hot.select("node", F.col("s0").alias("sketch")).distinct().mapInArrow(_flips, "z long, node long").groupBy("z").agg(F.collect_list("node").alias("n")).filter(F.size("n") > 1)
        return links.unionByName(shared_by.select(F.array_min("n").alias("a"), F.explode("n").alias("b"), F.lit(0).alias("apart")).filter("a <> b"))
    alone = prints.select("node", F.col("node").alias("component"))
    return links.unionByName(block_links(hot, prints, alone, tau, tau, 0).select("a", "b", "apart"))


def alike_links(nodes: DataFrame, texts: DataFrame, bits: int, tau: int, words: int, similarity: float) -> DataFrame:
    """Links (a, b) whose components are those of all pairs that share a bucket, differ in
    `tau` bits or fewer and whose texts share `similarity` of their shingles, whatever
    the size of the bucket. `nodes`: (node, fingerprint, few); `texts`: (id, text).

    Large buckets come after what the small ones link. There only nodes of different
    components are compared, in turns: a forest of the candidates is confirmed and its
    links join components, once by the nearest partners and once by others; the last
    turn confirms every candidate that is left between components.
    """
    mean = bits * math.acos(2 * similarity / (1 + similarity)) / math.pi
    sure = int(mean - 2 * math.sqrt(mean * (1 - mean / bits)))
    spark = nodes.sparkSession
    plan = wide_plan(nodes, bits, math.ceil(mean))
    sizes, masks = bucket_sizes(nodes, plan), bucket_masks(plan)
    release(spark)
    links = cut(small_links(shared_buckets(nodes, plan, sizes.filter(F.col("size") <= BUCKET)), nodes, bits, tau, sure, masks))
    release(spark)
    done = cut(confirm(links, texts, words, similarity, sure).unionByName(few_links(nodes, similarity)))
    hot = sizes.filter(F.col("size") > BUCKET)
    if not hot.take(1):
        return done
    hot = cut(shared_buckets(nodes, plan, hot, False))
    for turn in (0, 1, None):
        release(spark)
        more = cut(block_links(hot, nodes, components(done), sure, tau, turn, masks))
        if not more.take(1):
            break
        if turn is not None:  # trees only grow, so a bucket without candidates has none later on
            hot = cut(hot.join(more.select("part", "key").distinct(), ["part", "key"], "left_semi"))
        release(spark)
        done = cut(done.unionByName(confirm(more.select("a", "b", "apart").distinct(), texts, words, similarity, sure)))
    release(spark)
    return done


def few_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of nodes that have `few`
    shingles and share `similarity` of them (Jaccard). Sets so alike share one of the
    first of their shingles in order, as many as may be lacking and one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(v, np.uint64) for v in batch.column(1).to_pylist()]
            first = [u[: len(u) - math.ceil(similarity * len(u) - 1e-9) + 1] for u in sets]
            of = pa.array(np.repeat(np.arange(len(sets)), [len(u) for u in first]))
            key = np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(of), batch.column(1).take(of)], ["key", "node", "few"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, lx, right, rx in zip(*(batch.column(k).to_pylist() for k in range(4))):
                both, n = left + right, len(left)
                sets = [frozenset(np.frombuffer(v, np.uint64).tolist()) for v in lx + rx]

                up, kept = list(range(len(both))), []

                def root(i: int, up: list = up) -> int:
                    while up[i] != i:
                        up[i] = i = up[up[i]]
                    return i

                for i in range(n):  # what is linked already need not be compared
                    for j in range(n if right else i + 1, len(sets)):
                        r, s = root(i), root(j)
                        u, v = sets[i], sets[j]
                        if r != s and min(len(u), len(v)) >= similarity * max(len(u), len(v)):
                            common = len(u & v)
                            if common >= similarity * (len(u) + len(v) - common):
                                up[r] = s
                                kept.append((i, j))
                yield pa.RecordBatch.from_arrays([pa.array([both[k[c]] for k in kept], pa.int64()) for c in (0, 1)], ["a", "b"])

    rows = nodes.filter("few is not null").select("node", "few").mapInArrow(keys, "key long, node long, few binary")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return _dealt(rows.join(sizes, "key"), ["key"], ["few"]).mapInArrow(alike, "a long, b long")


def confirm(links: DataFrame, texts: DataFrame, words: int, similarity: float, sure: int) -> DataFrame:
    """The links of at most `sure` bits, and of the others those between different
    components of these whose texts share `similarity` of their shingles (Jaccard).
    `texts`: (id, text); only those of such links are shuffled."""
    firm = links.filter(F.col("apart") <= sure).select("a", "b")
    heads = cut(components(firm))
    loose = links.filter(F.col("apart") > sure).select("a", "b")
    for side in ("a", "b"):
        loose = loose.join(heads.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    loose = cut(loose.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))
    wanted = cut(loose.select(F.col("a").alias("id")).union(loose.select(F.col("b").alias("id"))).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [np.unique(shingle_hashes(t, words)).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.binary())], ["id", "shingles"])

    rows = maybe_among(texts, wanted, "id").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    shingles = rows.select("id", "text").mapInArrow(sets, "id long, shingles binary")
    both = loose.join(shingles.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(shingles.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):  # one at a time: a batch of them is large
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(common >= similarity * (len(u) + len(v) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return firm.unionByName(both.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"))


def near_duplicates(df: DataFrame, words: int = 3, bits: int = 64, tau: int = 2, similarity: float | None = None, choices: tuple[int, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint binary, component long) of every row.

    Component: the least id that links of `tau` bits or fewer reach, the row's
    own included. With `similarity` a link must also share so much of its shingles;
    this is checked on the texts, unless the fingerprints are so near that it is
    beyond doubt, whatever the size of their bucket; fingerprints are then those of
    the distinct shingles, and texts of few shingles are compared on these. Rows of
    equal fingerprints are one node. Null and empty texts have fingerprint zero; a very
    long text is a portion of its own; repeated rows are kept, rows of one id are one
    document; a row without id links to nothing and has no component; other
    columns are left out; an empty table gives no rows.
    """
    prints = cut(fingerprints(df, words, bits, id_col, text_col, similarity is not None).withColumnRenamed(id_col, "id"))
    few = [] if similarity is None else [F.max("few").alias("few")]
    nodes = cut(prints.filter("id is not null").groupBy("fingerprint").agg(F.min(F.col("id").cast("long")).alias("node"), *few))
    if similarity is None:
        links = near_links(nodes, bits, tau, choices).select("a", "b")
    else:
        texts = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
        links = alike_links(nodes, texts, bits, tau, words, similarity)
    # Rows of one id are one document, whatever their texts.
    several = prints.filter("id is not null").groupBy("id").agg(F.min("fingerprint").alias("p"), F.max("fingerprint").alias("q")).filter("p <> q").select("id")
    several = prints.join(several, "id").join(nodes, "fingerprint").select(F.col("node").alias("a"), F.col("id").cast("long").alias("b"))
    found = components(links.unionByName(several))
    of_print = nodes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component"))
    out = prints.join(of_print, "fingerprint", "left")
    return out.select(F.col("id").alias(id_col), "fingerprint", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
