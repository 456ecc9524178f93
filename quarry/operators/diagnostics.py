"""Per-chunk and per-document diagnostics; all but the statistics are projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import strip, token_estimate

PALETTE = 6
SHORT, LONG = 50, 600


def chunk_stats(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",), documents: DataFrame | None = None) -> DataFrame:
    """(keys, total_chunks, total_characters, avg_chunk_size, min_chunk_size,
    max_chunk_size, total_tokens_est): one aggregate with partial sums. With
    `documents`, keys without chunks get zeros."""
    n = F.length("text")
    out = chunks.groupBy(*keys).agg(
        F.count("*").alias("total_chunks"), F.sum(n).cast("long").alias("total_characters"), F.avg(n).alias("avg_chunk_size"),
        F.min(n).alias("min_chunk_size"), F.max(n).alias("max_chunk_size"),
    )
    if documents is not None:
        zero = {c: 0 for c in out.columns if c not in keys}
        out = documents.select(*keys).distinct().join(out, list(keys), "left").fillna(zero)
    return out.withColumn("total_tokens_est", token_estimate(F.col("total_characters")))


def with_overlap(chunks: DataFrame) -> DataFrame:
    """Adds token_estimate, overlap_text (what the next chunk repeats, "" if nothing),
    overlap_chars and links_next."""
    n = F.col("end_pos") - F.col("next_start")
    shared = F.when((F.col("next_start") < F.col("end_pos")) & (n <= F.length("text")), F.expr("right(text, end_pos - next_start)")).otherwise("")
    out = chunks.withColumn("token_estimate", token_estimate(F.length("text"))).withColumn("overlap_text", shared)
    return out.withColumn("overlap_chars", F.length("overlap_text")).withColumn("links_next", F.col("overlap_chars") > 0)


def with_highlight(chunks: DataFrame) -> DataFrame:
    """Adds before and overlap: the text, cut where the shared suffix begins."""
    keep = F.length("text") - F.length("overlap_text")
    return chunks.withColumn("before", F.substring("text", F.lit(1), keep)).withColumn("overlap", F.col("overlap_text"))


def ending(text: Column) -> Column:
    """complete, midphrase or cut, by the last character."""
    last = F.right(strip(text), F.lit(1))
    return F.when(last.isin(".", "!", "?"), "complete").when(last.isin(",", ":", ";"), "midphrase").otherwise("cut")


def length_flag(tokens: Column) -> Column:
    """SHORT, LONG or null."""
    return F.when(tokens < SHORT, "SHORT").when(tokens > LONG, "LONG")


def starts_lower(text: Column) -> Column:
    return strip(text).rlike(r"\A\p{IsLowercase}")


def with_quality(chunks: DataFrame) -> DataFrame:
    """Adds ending, length_flag, starts_lower, indicators (joined by spaces) and
    palette, the index of a colour."""
    tokens = token_estimate(F.length("text"))
    out = chunks.withColumn("ending", ending(F.col("text"))).withColumn("length_flag", length_flag(tokens)).withColumn("starts_lower", starts_lower(F.col("text")))
    return out.withColumn("indicators", F.concat_ws(" ", "ending", "length_flag", F.when(F.col("starts_lower"), "CUT"))).withColumn("palette", F.pmod(F.col("chunk_index"), F.lit(PALETTE)))


def summary_line(stats: DataFrame) -> DataFrame:
    """Adds a line of text about each row of statistics."""
    line = F.format_string("%d chunks, %.0f characters on average, %s in all, about %d tokens", "total_chunks", "avg_chunk_size", F.format_number("total_characters", 0), "total_tokens_est")
    return stats.withColumn("summary", line)


def recommend(text: Column) -> Column:
    """(size, overlap, expected_chunks, tip) by the text's length; an empty text has
    a tip only."""
    tokens = token_estimate(F.length(text))

    def row(size, overlap, expected, tip) -> Column:
        return F.struct(*(F.lit(v).cast("string").alias(n) for v, n in ((size, "size"), (overlap, "overlap"), (expected, "expected_chunks"), (tip, "tip"))))

    # The ranges for each class of length.
    return (
        F.when(F.length(text) == 0, row(None, None, None, "no text yet: nothing to go by"))
        .when(tokens < 500, row("100-150", "15-20%", "3-5", "short text: keep chunks narrow"))
        .when(tokens < 2000, row("200-300", "10-15%", "8-15", "middling text: neither narrow nor wide"))
        .otherwise(row("300-500", "10-15%", "15+", "long text: wider chunks cost less"))
    )


def file_preview(content: Column, lines: int = 10) -> Column:
    """The first lines, and how many more there are."""
    parts = F.split(content, "\n", -1)
    head = F.array_join(F.slice(parts, 1, lines), "\n")
    return F.when(F.size(parts) > lines, F.concat(head, F.format_string("\n... (%d more lines)", F.size(parts) - lines))).otherwise(head)


def format_file_size(size: Column) -> Column:
    """One decimal and the largest unit that gives less than 1024, up to TB."""
    size = size.cast("double")
    out = F.format_string("%.1f TB", size / 1024**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", size / 1024**power)).otherwise(out)
    return out
