"""Bodies of streamed answers as columns: the pieces of text in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(body: Column) -> Column:
    return F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n", -1)


def ndjson_pieces(body: Column) -> Column:
    """The `response` of every line that is a JSON object with one, in order."""
    parsed = F.transform(F.filter(_lines(body), lambda x: F.length(x) > 0), lambda x: F.get_json_object(x, "$.response"))
    return F.filter(parsed, lambda x: x.isNotNull())


def sse_pieces(body: Column) -> Column:
    """The contents of `data:` lines up to the end mark; what can't be read is left out."""
    data = F.filter(_lines(body), lambda x: x.startswith("data: ") & ~x.endswith("[DONE]"))
    parsed = F.transform(data, lambda x: F.get_json_object(F.substring(x, 7, 1 << 30), "$.choices[0].delta.content"))
    return F.filter(parsed, lambda x: F.coalesce(F.length(x) > 0, F.lit(False)))


def answer(pieces: Column) -> Column:
    return F.array_join(pieces, "")
