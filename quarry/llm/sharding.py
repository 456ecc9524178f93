"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, in
which only buckets over the byte limit split on another bit.

All of it is DataFrame work. Sizes of the buckets of every depth are sums of the same
small table of cells, so a whole tree of splits is one aggregate with map-side sums.
The directory has a few rows a shard and stays a DataFrame; rows find their bucket by
an equi-join on a hash prefix, which no source or key can make hot.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text

#: Bits of the hash: 15 hexadecimal digits.
BITS = 60
DEFAULT_LIMIT = 32 << 20
#: Bits by which the first look goes deeper than evenly filled shards would need, and
#: by which a later look at what is still too full goes on.
SPARE_BITS, MORE_BITS = 4, 8


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    """60 bits of an md5 over id and text: rows of one id and equal texts alike."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(whole_text(text_col)))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def assign_shards(df: DataFrame, limit: int = DEFAULT_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, hash, shard_depth, shard_prefix, shard_bytes, oversized) a row.

    A shard is the bucket of all hashes whose first shard_depth bits are
    shard_prefix, and holds `limit` bytes of text at most. What no bit can split
    (one row over the limit, such as a very long text, or rows equal in id and text)
    is one shard, marked oversized if it exceeds the limit. Null ids and texts count
    as empty ones; an empty table gives no rows; other columns are left out.
    """
    rows = cut(df.select(F.col(id_col), F.octet_length(whole_text(text_col)).cast("long").alias("n_bytes"), row_hash(id_col, text_col).alias("hash")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    left, done = rows, None
    while True:
        buckets = cut(bucket_sizes(left, low, depth))
        part = left.withColumn("cell", _prefix(depth)).join(directory(buckets, low, depth, limit), "cell").drop("cell")
        done = part if done is None else done.unionByName(part)
        full = buckets.filter((F.col("d") == depth) & ~_fits(limit)).select(F.col("p").alias("cell"))
        if depth == BITS or not full.take(1):
            break
        left = left.withColumn("cell", _prefix(depth)).join(full, "cell", "left_semi").drop("cell")
        low, depth = depth, min(BITS, depth + MORE_BITS)
    return done.withColumn("oversized", F.col("shard_bytes") > limit)


def _prefix(depth: int) -> F.Column:
    return F.shiftright("hash", BITS - depth)


def _fits(limit: int) -> F.Column:
    """Whether a bucket is within the limit, or holds one hash only, which no bit splits."""
    return (F.col("bytes") <= limit) | (F.col("least") == F.col("most"))


def bucket_sizes(rows: DataFrame, low: int, depth: int) -> DataFrame:
    """(d, p, bytes, least, most): the bytes and the least and largest hash of every
    bucket of low..depth bits. Sums go up from the cells of `depth` bits; those of few
    bits are summed in every task before they are shuffled."""
    cells = rows.groupBy(_prefix(depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.min("hash").alias("least"), F.max("hash").alias("most"))
    ways = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("d")).withColumn("p", F.expr(f"shiftright(cell, {depth} - d)"))
    return ways.groupBy("d", "p").agg(F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most"))


def directory(buckets: DataFrame, low: int, depth: int, limit: int) -> DataFrame:
    """(cell, shard_depth, shard_prefix, shard_bytes): for every prefix of `depth` bits its
    shard. From `low` bits down a bucket that does not fit splits on the next bit, so
    its two halves are there; a shard is a half, or the root, that fits."""
    halves = buckets.filter(~_fits(limit)).select((F.col("d") + 1).alias("d"), F.explode(F.array(F.col("p") * 2, F.col("p") * 2 + 1)).alias("p"))
    fitting = buckets.filter(_fits(limit))
    shards = fitting.join(halves, ["d", "p"], "left_semi").unionByName(fitting.filter(F.col("d") == low))
    size = F.expr(f"shiftleft(1L, {depth} - d)")
    cells = F.sequence(F.col("p") * size, (F.col("p") + 1) * size - 1)
    return shards.select(F.explode(cells).alias("cell"), F.col("d").alias("shard_depth"), F.col("p").alias("shard_prefix"), F.col("bytes").alias("shard_bytes"))


def write_shards(df: DataFrame, path: str, limit: int = DEFAULT_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows as Parquet, a folder a shard. A task writes whole shards; the rows
    of an oversized one are dealt to several tasks by the partition they come from."""
    placed = assign_shards(df, limit, id_col, text_col).groupBy(F.col("hash").alias("__hash")).agg(*(F.first(c).alias(c) for c in ("shard_depth", "shard_prefix", "shard_bytes")))
    out = df.withColumn("__hash", row_hash(id_col, text_col)).withColumn("__from", F.spark_partition_id()).join(placed, "__hash")
    dealt = F.pmod(F.col("__from"), F.ceil(F.col("shard_bytes") / limit).cast("int") + 1)
    out = out.withColumn("__part", F.when(F.col("shard_bytes") > limit, dealt).otherwise(0))
    out = out.repartition("shard_depth", "shard_prefix", "__part").select(*df.columns, "shard_depth", "shard_prefix")
    out.write.partitionBy("shard_depth", "shard_prefix").mode("overwrite").parquet(path)
