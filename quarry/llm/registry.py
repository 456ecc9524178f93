"""The training-data queries, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, gam, jpeg, lm, sharding, simhash, substrings, tokens, warc
from .common import shared_path

VOCABULARY = "word_bpe_49k.json"
#: So small that shards of several depths come about in every table.
SHARD_BYTES = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=64, tau=2)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, least=0)
    return warc.read_archive(spark, path).drop("url_key")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages),
d AS (SELECT *, sha1(html) AS h FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * k // 4 + 1)::INTEGER, 2))::INTEGER >> (3 - 5 * k % 4)::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to
FROM d
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"), length=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, i, words[i : i + 19] AS seq FROM (SELECT *, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
k AS (SELECT w.doc_id, w.words, coalesce(list(g.i) FILTER (g.i IS NOT NULL), []) AS gone FROM w LEFT JOIN g USING (doc_id) GROUP BY ALL)
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM k
"""


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = jpeg.store_texts(table(spark, sf_dir, "documents"))
    read = jpeg.read_media(stored, keep=("doc_id", "n_bytes", "media"))
    payload = F.col("thumbnail")
    return read.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.format_string("%dx%d:%d:%s", "width", "height", "frames", "thumbnail_hash").alias("feature"),
    )


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
w AS (SELECT d.*, k::INTEGER AS depth, (hash >> (60 - k::INTEGER)) AS prefix FROM d, range(0, 61) r(k)),
b AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS bytes, min(hash) AS lo, max(hash) AS hi FROM w GROUP BY ALL),
f AS (SELECT * FROM b WHERE bytes <= {SHARD_BYTES} OR lo = hi),
c AS (SELECT DISTINCT hash FROM d),
s AS (SELECT c.hash, min(f.depth) AS depth FROM c JOIN f ON f.prefix = (c.hash >> (60 - f.depth)) GROUP BY 1)
SELECT d.doc_id, d.n_bytes, d.hash, s.depth AS shard_depth, f.prefix AS shard_prefix, f.bytes AS shard_bytes, f.bytes > {SHARD_BYTES} AS oversized
FROM d JOIN s USING (hash) JOIN f ON f.depth = s.depth AND f.prefix = (d.hash >> (60 - s.depth))
"""


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", folds=5, held_out=0, cut=0.3)


def op10_gru_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), folds=7, held_out=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_warc_capture_index": op3_warc_capture_index,
    "op4_token_counts": op4_token_counts,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_media_columns": op6_media_columns,
    "op7_extendible_sharding": op7_extendible_sharding,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_quality_gam": op9_quality_gam,
    "op10_gru_language_model": op10_gru_language_model,
}

ORACLES: dict[str, str] = {
    "op3_warc_capture_index": OP3_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op7_extendible_sharding": OP7_SQL,
}
