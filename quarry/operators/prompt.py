"""Prompts and chat histories as columns; generation by a client of your own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts of the two prompts.
INSTRUCTION = "Use the following context to answer the question. If the answer is not in the context, say so."
SEPARATOR = "\n\n---\n\n"
SYSTEM = "You are a helpful assistant. Answer questions based on the provided context."
CLOSING = "Answer based on the context provided above. If the answer cannot be found in the context, say so."


def contexts(hits: DataFrame, query_id: str = "query_id", most: int = 3) -> DataFrame:
    """(query_id, chunks): the texts of the best hits in order of rank."""
    ranked = hits.filter(F.col("rank") <= most).groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("r"))
    return ranked.select(query_id, F.transform("r", lambda x: x["text"]).alias("chunks"))


def provider_prompt(query: Column, chunks: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION + "\n\nContext:\n"), F.array_join(chunks, SEPARATOR), F.lit("\n\nQuestion: "), query, F.lit("\n\nAnswer:"))


def numbered_prompt(query: Column, chunks: Column, system: str = SYSTEM) -> Column:
    blocks = F.transform(chunks, lambda c, i: F.concat(F.lit("Context "), (i + 1).cast("string"), F.lit(":\n"), c))
    return F.concat(F.lit(system + "\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n\nQuestion: "), query, F.lit("\n\n" + CLOSING))


def chat_history(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages): (role, content) in order of turn."""
    listed = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return listed.select(key, F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def generate_udf(connect: Callable[[], Callable[[str], str]]):
    """A vectorised function from prompt to answer; a failure's text is the answer's end."""

    def one(generate: Callable[[str], str], prompt: str | None) -> str | None:
        if prompt is None:
            return None
        try:
            return generate(prompt)
        except Exception as problem:  # any failure of a remote service is told in the answer
            return f"\n\nError: {problem}"

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = connect()
        for prompts in parts:
            yield prompts.map(lambda p: one(generate, p))

    return run
