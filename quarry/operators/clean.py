"""Text cleaning: six steps in a fixed order, an own cleaner, a final strip."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import WS, is_blank, rstrip, strip, universal_newlines


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def strip_line_ends(text: Column) -> Column:
    """Each line without white space at its end. May leave new runs of newlines."""
    return F.array_join(F.transform(F.split(text, "\n", -1), rstrip), "\n")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t]+", " ")


def remove_page_lines(text: Column) -> Column:
    """Without lines "Page 3"; white space around them goes as well."""
    return F.regexp_replace(text, rf"(?md)^{WS}*Page \p{{Nd}}+{WS}*$", "")


def remove_rules(text: Column) -> Column:
    """Without lines of three hyphens or more."""
    return F.regexp_replace(text, rf"(?md)^{WS}*-{{3,}}{WS}*$", "")


#: In this order; a step sees what the one before has left.
STEPS: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("newlines", universal_newlines),
    ("newline_runs", collapse_newlines),
    ("line_ends", strip_line_ends),
    ("spaces", collapse_spaces),
    ("page_lines", remove_page_lines),
    ("rules", remove_rules),
)


def cleaner_udf(function: Callable[[str], str]):
    """An own cleaner as a vectorised function. A row on which it fails keeps its text."""

    def one(text):
        if text is None:
            return None
        try:
            return function(text)
        except Exception as problem:  # any failure of foreign code keeps the row
            warnings.warn(f"the cleaner failed: {problem}", stacklevel=1)
            return text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def clean_column(text: Column, steps: tuple[str, ...] | None = None) -> Column:
    for name, step in STEPS:
        if steps is None or name in steps:
            text = step(text)
    return text


def quick_clean(df: DataFrame, text_col: str = "text", cleaner: Callable[[str], str] | None = None, cleaned_col: str = "cleaned", removed_col: str = "removed_chars") -> DataFrame:
    """Adds the cleaned text and how many characters went. Blank texts stay as they are."""
    text = F.col(text_col)
    done = clean_column(text)
    if cleaner is not None:
        done = cleaner_udf(cleaner)(done)
    out = df.withColumn(cleaned_col, F.when(is_blank(text), text).otherwise(strip(done)))
    return out.withColumn(removed_col, F.length(text_col) - F.length(cleaned_col))
