"""Column helpers for text: white space as Unicode has it, lines, lengths.

Lengths and positions count code points; positions are 0-based, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space characters, as a Java regex class and its complement.
_MEMBERS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS, NON_WS = f"[{_MEMBERS}]", f"[^{_MEMBERS}]"


def strip(text: Column) -> Column:
    """Without white space at both ends (trim() only knows U+0020)."""
    return F.regexp_replace(F.regexp_replace(text, rf"\A{WS}+", ""), rf"{WS}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}+\z", "")


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but white space."""
    return ~F.coalesce(text, F.lit("")).rlike(NON_WS)


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def split_literal(text: Column, separator: str) -> Column:
    return F.split(text, "\\Q" + separator + "\\E", -1)


def stripped_parts(text: Column, pattern: str) -> Column:
    """Parts between matches of a pattern, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern, -1), strip), lambda p: F.length(p) > 0)


def find(text: Column, part: Column, start: Column) -> Column:
    """0-based place of `part` in `text` from `start` on; -1 where there is none."""
    return F.when(F.length(part) == 0, F.when(start <= F.length(text), start).otherwise(-1)).otherwise(F.call_function("locate", part, text, start + 1) - 1)


def token_estimate(characters: Column) -> Column:
    """Four characters a token, rounded down."""
    return F.floor(characters / 4).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)
