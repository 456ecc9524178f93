"""What the training-data operators share: shared folders, batches of text as
numpy buffers, vectorised word hashing and connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into numpy arrays at a time.
CHUNK_BYTES = 1 << 20

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a
    local one is chosen only where the session names none, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or "/tmp/checkpoints/quarry")
    return (named or "/tmp/checkpoints/quarry").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of what nothing refers to any more. It does so
    when the driver collects garbage, which may not happen for a whole job."""
    gc.collect()
    spark._jvm.System.gc()


#: Numbers of 64 bits in the filter of maybe_among() at the utmost.
FILTER_WORDS = 1 << 20


def maybe_among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose number `key` is among those of `wanted`, and few others, without a
    shuffle of the rows: bits of a hash are broadcast, 16 MB of them at the utmost."""
    spot = lambda: F.pmod(F.xxhash64(key), F.lit(64 * FILTER_WORDS))
    bit = F.expr("shiftleft(1L, cast(_spot & 63 AS int))")
    bits = wanted.select(spot().alias("_spot")).groupBy(F.shiftright("_spot", 6).alias("_w")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_spot", spot()).withColumn("_at", F.shiftright("_spot", 6))
    hit = (F.col("_at") == F.col("_w")) & (F.col("_bits").bitwiseAND(bit) != 0)
    return marked.join(F.broadcast(bits), hit, "left_semi").drop("_spot", "_at")


def whole_text(column: str = "text") -> F.Column:
    """The text; null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(column: str, mod: int) -> F.Column:
    """crc32 of an id as text, modulo `mod`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def most_frequent(counts: DataFrame, n_col: str, most: int) -> DataFrame:
    """The rows of the largest counts, `most` at the utmost: those over a threshold
    from a histogram in eighths of a doubling, so the driver sees 512 rows."""
    bins = F.floor(F.log2(F.col(n_col)) * 8).cast("int")
    total, low = 0, 1 << 20
    for r in sorted(counts.groupBy(bins.alias("b")).count().collect(), key=lambda r: -r.b):
        if total + r["count"] > most:
            break
        total, low = total + r["count"], r.b
    return counts.filter(bins >= low)


def bounded_sample(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """All rows, or of more than `most` an even share by a hash of the id; `most` at
    the utmost."""
    n = df.count()
    if n <= most:
        return df
    even = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30))
    return df.filter(even < int((1 << 30) * 0.97 * most / n)).limit(most)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls are empty) and its offsets, len + 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str | int = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each, one row at least."""
    offsets, start, n = buffers(batch.column(column))[1], 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts, and for each
    text (len + 1) the index of its first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the lane's base and of its inverse modulo 2^64."""
    have = _POWERS.get(lane)
    if have is None or len(have[0]) < n:
        size = max(CHUNK_BYTES + 1, n)
        made = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = _POWERS[lane] = (made[0], made[1])
    return have


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, taken from prefix sums
    of CHUNK_BYTES of the buffer at a time, then mixed."""
    out, a = np.zeros(len(starts), U64), 0
    while a < len(starts):
        base = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        if ends[b - 1] - base > CHUNK_BYTES:  # one very long word, piece by piece
            total, at, end = 0, base, int(ends[a])
            while at < end:
                piece = data[at : min(end, at + CHUNK_BYTES)]
                total += int(np.sum((piece.astype(U64) + U64(1)) * _powers(lane, len(piece))[0][: len(piece)])) * pow(_BASES[lane], at - base, 1 << 64)
                at += len(piece)
            out[a] = total & (1 << 64) - 1
        else:
            piece = data[base : ends[b - 1]]
            up, down = _powers(lane, len(piece) + 1)
            sums = np.zeros(len(piece) + 1, U64)
            np.cumsum((piece.astype(U64) + U64(1)) * up[: len(piece)], out=sums[1:])
            out[a:b] = (sums[ends[a:b] - base] - sums[starts[a:b] - base]) * down[starts[a:b] - base]
        a = b
    return mix(out)


def window_hashes(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hashes of all windows of `length` consecutive entries, by doubling:
    a window of 2l is two neighbours of l. The last ones run over the end."""
    base = _BASES[lane]
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, have, pieces = np.zeros(n, U64), 0, words
    size, power = 1, base
    rest = length
    while rest:
        if rest & 1:
            out = out * U64(power) + pieces[have : have + n]
            have += size
        rest >>= 1
        if rest:
            pieces = pieces[:-size] * U64(power) + pieces[size:]
            size *= 2
            power = power * power & (1 << 64) - 1
    return mix(out)


#: Rows of one key, at least and as a share of all, that a join does not deal by the key.
HUB_ROWS, HUB_SHARE = 1000, 1000
#: Links up to which one task finds the components, in some 100 MB; more are dealt to many.
ONE_TASK = 500_000


def with_least(rows: DataFrame, n: int) -> DataFrame:
    """(u, v, m): the rows (u, v) with the least v of their u. A key of more than
    HUB_ROWS rows and of a HUB_SHARE-th of all n is a hub: there are HUB_SHARE of them at the
    utmost, whose least v are broadcast, so that their rows stay where they are."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    most = max(HUB_ROWS, n // HUB_SHARE)
    hubs = least.filter(F.col("n") > most).select("u", "m").collect()
    plain = least.select("u", "m")
    if not hubs:
        return rows.join(plain, "u")
    known = F.broadcast(rows.sparkSession.createDataFrame(hubs, "u long, m long"))
    return rows.join(known, "u", "left_anti").join(plain, "u").unionByName(rows.join(known, "u"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of links (u, v), all in one task: the least node is the root."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while (j := up.setdefault(i, i)) != i:
            up[i] = i = up[j]
        return i

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(u), root(v)))
            up[high] = low
    nodes = list(up)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(list(map(root, part)), pa.int64())], ["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components: (node, component), the component being its least
    node, for every node that occurs in `links`.

    Alternating large-star and small-star steps; every step is an aggregate with
    map-side minimum and one join of pairs of numbers, in which the links of a node
    that has very many stay apart. Lineage is cut with a reliable checkpoint after
    each round. Up to ONE_TASK links are joined in one task, with the same result.
    """
    edges = cut(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v").distinct())
    if edges.count() <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_joined, "node long, component long")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    sign = None
    for _ in range(rounds):
        got = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if got == sign:
            break
        sign, n = got, 2 * got[0]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, n).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = with_least(large, n)
        edges = cut(low.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("the components did not settle")
    found = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(found, nodes.node == found.u, "left").select("node", F.coalesce("component", "node").alias("component"))
