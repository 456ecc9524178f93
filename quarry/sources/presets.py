"""Presets of chunking parameters: built in, and saved as JSON."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = "name string, strategy string, chunk_size int, overlap_percent int, description string, created_at string"

# Names and parameters of the built-in presets.
BUILT_IN = (
    ("📄 General Text", "token", 256, 10, "A balanced start for most texts"),
    ("💬 Q&A / FAQ", "token", 128, 15, "Small chunks for questions about facts"),
    ("📚 Long Documents", "paragraph", 512, 10, "Large chunks where context matters"),
    ("💻 Code Files", "recursive", 400, 20, "Follows the structure of source code"),
    ("⚖️ Legal/Technical", "sentence", 300, 25, "More overlap for references between sentences"),
    ("🎯 High Precision", "token", 100, 30, "Very small chunks for exact matches"),
    ("📝 Summarization", "paragraph", 800, 5, "Large chunks that keep the thread"),
    ("💬 Chat/Support", "sentence", 150, 20, "Keeps the context of a conversation"),
)


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*p, "") for p in BUILT_IN], SCHEMA)


def file_name(name: str) -> str:
    """Letters, digits, hyphen and underscore stay, all else becomes an underscore."""
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in name)


def file_name_column(name):
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def saved(spark: SparkSession, path: str) -> DataFrame:
    """Presets below `path`; files that aren't valid are left out."""
    try:
        rows = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows.filter(F.col("name").isNotNull() & F.col("strategy").isNotNull())


def list_presets(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Built-in presets, then saved ones of other names (case counts)."""
    own = built_in(spark).withColumn("built_in", F.lit(True))
    if path is None:
        return own
    return own.unionByName(saved(spark, path).join(own, "name", "left_anti").withColumn("built_in", F.lit(False)))


def load_preset(spark: SparkSession, name: str, path: str | None = None) -> dict | None:
    """A built-in preset whatever the case, else a saved one, else None."""
    for p in BUILT_IN:
        if p[0].lower() == name.lower():
            return dict(zip(("name", "strategy", "chunk_size", "overlap_percent", "description", "created_at"), (*p, "")))
    if path is None:
        return None
    rows = saved(spark, path).filter(file_name_column(F.col("name")) == file_name(name)).limit(1).collect()
    return rows[0].asDict() if rows else None


def _folder(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{file_name(name)}"


def save_preset(spark: SparkSession, path: str, name: str, strategy: str, chunk_size: int, overlap_percent: int, description: str = "", created_at: str | None = None) -> str:
    """Writes the preset, over one of the same file name; returns where."""
    row = (name, strategy, chunk_size, overlap_percent, description, created_at or datetime.now().isoformat())
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").json(_folder(path, name))
    return _folder(path, name)


def delete_preset(spark: SparkSession, path: str, name: str) -> bool:
    """False for a built-in preset or a missing one."""
    if any(p[0].lower() == name.lower() for p in BUILT_IN) or not re.search(r"\w", file_name(name)):
        return False
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(path, name))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
