"""Embeddings: a hashing embedder in Arrow batches and of built-in functions, embedders
of your own, reuse of vectors by text."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[ \n]+", -1), lambda w: F.length(w) > 0)


#: Terms whose dimension a worker remembers.
REMEMBERED = 200_000


def hashing_embedder(dimensions: int = DIMENSIONS):
    """As hashing_embedding(), as a function of Arrow batches: a term is hashed once, and
    all counts of a batch are one histogram. A null text has zeros, like an empty one."""

    @F.arrow_udf("array<double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places: dict[str, int] = {}
        for texts in parts:
            found: list[int] = []
            for row, text in enumerate(texts.to_pylist()):
                for w in (text or "").replace("\n", " ").split(" "):
                    if w:
                        if (place := places.get(w)) is None:
                            if len(places) >= REMEMBERED:
                                places.clear()
                            place = places[w] = int(md5(w.encode("utf-8")).hexdigest()[:7], 16) % dimensions
                        found.append(row * dimensions + place)
            counts = np.bincount(np.array(found, np.int64), minlength=len(texts) * dimensions).reshape(-1, dimensions).astype(np.float64)
            norm = np.sqrt((counts * counts).sum(1, keepdims=True))
            vectors = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
            ends = np.arange(len(texts) + 1, dtype=np.int32) * dimensions
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))

    return lambda text: run(F.lower(text))


def hashing_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Term counts in hashed dimensions, of length one; zeros for a text without terms.
    By built-in functions alone, for plans without Python; long texts take far longer."""
    from quarry.functions.text import let

    place = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long"), F.lit(dimensions))

    def vector(places: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(places, lambda p: p == d)).cast("double"))

        def scaled(c: Column) -> Column:
            norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
            return let(norm, lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

        return let(counts, scaled)

    return let(F.transform(terms(text), place), vector)


def embedder_udf(connect: Callable[[], Callable[[list[str]], Iterable[Iterable[float]]]], batch: int = 64):
    """A vectorised function from text to array<float>. `connect` runs once a
    partition and gives a function from texts to vectors, called with up to `batch`."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = connect()
        for texts in parts:
            out: list = []
            for a in range(0, len(texts), batch):
                out += [[float(x) for x in v] for v in embed(texts.iloc[a : a + batch].tolist())]
            yield pd.Series(out)

    return run


def embed(df: DataFrame, embedder=None, text_col: str = "text", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds a vector to every row: the hashing embedder's, or that of a function."""
    return df.withColumn(vector_col, (embedder or hashing_embedder(dimensions))(F.col(text_col)))


def embed_distinct(df: DataFrame, embedder=None, text_col: str = "text", vector_col: str = "embedding", known: DataFrame | None = None) -> DataFrame:
    """As embed(), but every distinct text is embedded once; with `known`, a table of
    (text, vector), only texts that it lacks. Worth its join for costly embedders."""
    texts = df.select(text_col).filter(F.col(text_col).isNotNull()).distinct()
    if known is not None:
        known = known.select(text_col, vector_col).dropDuplicates([text_col])
        made = embed(texts.join(known, text_col, "left_anti"), embedder, text_col, vector_col).unionByName(known)
    else:
        made = embed(texts, embedder, text_col, vector_col)
    return df.join(made, text_col, "left")


def check_dimensions(df: DataFrame, vector_col: str = "embedding") -> int | None:
    """The one width of all vectors (None without any); ValueError if there are several."""
    widths = [r[0] for r in df.select(F.size(vector_col)).filter(F.col(vector_col).isNotNull()).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("vectors of several widths")
    return widths[0] if widths else None


class EmbeddingCache:
    """Vectors by text within one process; the least recently used goes first."""

    def __init__(self, most: int = 1000):
        self.most = most
        self._kept: OrderedDict[str, list[float]] = OrderedDict()

    def get(self, text: str) -> list[float] | None:
        if text in self._kept:
            self._kept.move_to_end(text)
        return self._kept.get(text)

    def put(self, text: str, vector: list[float]) -> None:
        self._kept[text] = vector
        self._kept.move_to_end(text)
        while len(self._kept) > self.most:
            self._kept.popitem(last=False)

    def clear(self) -> None:
        self._kept.clear()

    def __len__(self) -> int:
        return len(self._kept)
