"""Chunking parameters: sizes, overlaps, exports."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES, OVERLAPS = range(50, 1001, 50), range(0, 51, 5)

#: What users of two libraries paste; both take characters, four a token.
LANGCHAIN = "from langchain_text_splitters import RecursiveCharacterTextSplitter\n\n# chunks of about %d tokens\nsplitter = RecursiveCharacterTextSplitter(chunk_size=%d, chunk_overlap=%d)\n"
LLAMAINDEX = "from llama_index.core.node_parser import SentenceSplitter\n\nparser = SentenceSplitter(chunk_size=%d, chunk_overlap=%d)\n"


@dataclass
class ChunkConfig:
    strategy: str = "token"
    chunk_size: int = 200
    overlap_percent: int = 10
    overlap_tokens: int = 20

    @classmethod
    def from_dict(cls, values: dict) -> ChunkConfig:
        return cls(**{k: v for k, v in values.items() if k in cls.__dataclass_fields__})

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    def to_langchain(self) -> str:
        return LANGCHAIN % (self.chunk_size, self.chunk_size * 4, self.overlap_tokens * 4)

    def to_llamaindex(self) -> str:
        return LLAMAINDEX % (self.chunk_size * 4, self.overlap_tokens * 4)


def export_config(config: ChunkConfig, form: str = "json") -> str:
    forms = {"json": config.to_json, "langchain": config.to_langchain, "llamaindex": config.to_llamaindex}
    if form not in forms:
        raise ValueError(f"unknown format: {form}")
    return forms[form]()


def export_column(form: str) -> Column:
    """The export as a column over (strategy, chunk_size, overlap_percent, overlap_tokens)."""
    size, overlap = F.col("chunk_size"), F.col("overlap_tokens")
    if form == "json":
        return F.to_json(F.struct("strategy", "chunk_size", "overlap_percent", "overlap_tokens"))
    if form == "langchain":
        return F.format_string(LANGCHAIN, size, size * 4, overlap * 4)
    if form == "llamaindex":
        return F.format_string(LLAMAINDEX, size * 4, overlap * 4)
    raise ValueError(f"unknown format: {form}")


def from_json_column(text: Column) -> Column:
    """(strategy, chunk_size, overlap_percent, overlap_tokens) of a JSON text, with defaults."""
    parsed = F.from_json(text, "strategy string, chunk_size int, overlap_percent int, overlap_tokens int")
    defaults = ChunkConfig().to_dict()
    return F.struct(*(F.coalesce(parsed[k], F.lit(v)).alias(k) for k, v in defaults.items()))


def chunking_overlap(size: Column, percent: Column) -> Column:
    """Overlap in tokens, as chunking takes it: the share first, then the product."""
    return (size * (percent / F.lit(100.0))).cast("int")


def export_overlap(size: Column, percent: Column) -> Column:
    """Overlap in tokens, as exports take it: the product first. Rounding differs at times."""
    return (size * percent.cast("double") / F.lit(100.0)).cast("int")


def clamp_size(size: Column) -> Column:
    return F.greatest(F.least(size, F.lit(1000)), F.lit(50))


def clamp_percent(percent: Column) -> Column:
    return F.greatest(F.least(percent, F.lit(50)), F.lit(0))


def grid(spark: SparkSession) -> DataFrame:
    """All sizes and overlaps that can be set: (chunk_size, overlap_percent,
    overlap_tokens, export_overlap_tokens)."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(50), F.lit(1000), F.lit(50))).alias("chunk_size"))
    both = one.select("chunk_size", F.explode(F.sequence(F.lit(0), F.lit(50), F.lit(5))).alias("overlap_percent"))
    size, percent = F.col("chunk_size"), F.col("overlap_percent")
    return both.withColumn("overlap_tokens", chunking_overlap(size, percent)).withColumn("export_overlap_tokens", export_overlap(size, percent))
