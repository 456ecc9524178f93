"""From raw documents to token ids, in five stages.

Each stage reads what its predecessor wrote. All but the last return the columns
of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, gam, simhash, substrings
from quarry.llm.common import cut, shared_path

VOCABULARY = "word_bpe_49k.json"
#: Near copies share 0.8 of their five-word shingles. At that similarity 77.6 of 512
#: fingerprint bits differ on average, acos(2 * 0.8 / 1.8) / pi of them, and rarely
#: over 94.
SHINGLE_WORDS, SIMILARITY, BITS, DIFFERING = 5, 0.8, 512, 94
SUBSTRING_WORDS = 20
QUALITY_CUT = 0.3


def aside(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], dict[str, str]]:
    """The documents with other columns than id and text under names that no operator
    uses, these names, and the way back."""
    names = {c: c if c in ("doc_id", "text") else f"__{i}" for i, c in enumerate(docs.columns)}
    back = {v: k for k, v in names.items()}
    return docs.toDF(*names.values()), tuple(v for k, v in names.items() if k not in ("doc_id", "text")), back


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Every row is judged by its own
    text, whatever its id; null and empty texts have a score as well; repeated rows go or stay
    together; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, others, back = aside(docs)
    scored = gam.classify(plain, labels, "quality", cut=QUALITY_CUT, keep=("text", *others))
    return scored.filter("predicted = 1").select(*plain.columns).toDF(*(back[c] for c in plain.columns))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, `__row`: the id, where one row alone has it.
    Rows without an id, and those of an id that others have as well, are numbered
    beyond all ids, so that each text counts as a document."""
    ids = docs.groupBy("doc_id").count()
    shared = cut(ids.filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("__shared")))
    if not shared.take(1):
        return docs.withColumn("__row", F.col("doc_id").cast("long"))
    beyond = max(0, ids.agg(F.max("doc_id")).first()[0] or 0) + 1
    several = cut(docs.join(shared, docs["doc_id"].eqNullSafe(shared["__shared"]), "left_semi").withColumn("__row", F.monotonically_increasing_id() + beyond))
    alone = docs.filter("doc_id is not null").join(shared, docs["doc_id"] == shared["__shared"], "left_anti")
    return alone.withColumn("__row", F.col("doc_id").cast("long")).unionByName(several)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id. Every row is judged by
    its text: rows without an id, or of one id and different texts, are documents each.
    Null and empty texts are copies of each other; an empty table stays empty."""
    plain, _, back = aside(docs)
    rows = numbered(plain)
    found = simhash.near_duplicates(rows, SHINGLE_WORDS, BITS, DIFFERING, SIMILARITY, id_col="__row")
    heads = found.filter("__row = component").select("__row")
    return rows.join(heads, "__row", "left_semi").select(*plain.columns).toDF(*(back[c] for c in plain.columns))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier; what has no words left goes."""
    plain, others, back = aside(docs)
    out = substrings.dedup_substrings(plain, SUBSTRING_WORDS, keep=others, as_is=True)
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumnRenamed("kept", "text")
    out = out.select(*plain.columns).toDF(*(back[c] for c in plain.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Every row is judged by its own text, whatever
    its id; null and empty texts stay; an empty table stays empty."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, as little-endian unsigned 32-bit integers, and digests of the ids
    and of the text that they decode to, a row for each row. Null and empty texts have no
    ids; null ids and repeated rows stay as they are; an empty table gives no rows."""
    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_round_trip", bpe_stage),
]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again. What
    a stage has read is removed when its own rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{k - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return STAGES[-1][1](spark, docs, sf_dir)
