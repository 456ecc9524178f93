"""Exact cosine search, result cards, and an approximate search by hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.shared import settled

#: Values of query vectors that are broadcast at a time; more queries take several passes.
BROADCAST_VALUES = 4_000_000
#: Similarities that a task has at a time: rows by queries, some 32 MB.
CELLS = 4_000_000
TOP_K, PROMPT_K = 5, 3
BAR = 30


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance; 0 where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, query_id: str = "query_id", vector_id: str = "chunk_id", query_vec: str = "query_embedding", vector_vec: str = "embedding", digits: int | None = None, carry: str | None = None) -> DataFrame:
    """(query_id, rank, vector_id, similarity[, carry]): the k nearest of each query, exact, by
    falling similarity, then by id. Null vectors match nothing.

    A stated set of queries against all rows: blocks of queries of a bounded size are
    broadcast, each task multiplies them with its rows and keeps its own k best of
    each query, and only those are shuffled.
    """
    return _blockwise(queries, vectors, k, (query_id, vector_id, query_vec, vector_vec), digits, carry, None)


def _blockwise(queries: DataFrame, vectors: DataFrame, k: int, names: tuple[str, str, str, str], digits: int | None, carry: str | None, signs: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """top_k(); with `signs`, which gives the buckets of unit vectors (a row each, a column a
    table), only of pairs that agree in a column. Vectors stay in their tasks either way."""
    query_id, vector_id, query_vec, vector_vec = names
    spark = vectors.sparkSession
    rows = queries.select(query_id, query_vec).filter(F.col(query_vec).isNotNull())
    values = rows.agg(F.sum(F.size(query_vec))).first()[0] or 0
    blocks = max(1, -(-values // BROADCAST_VALUES))
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, query_id), (vectors, vector_id))}
    id_type, vector_type = _arrow(queries, query_id), _arrow(vectors, vector_id)
    extra = [F.col(carry).cast("string").alias(carry)] if carry else []
    source = vectors.select(vector_id, vector_vec, *extra).filter(F.col(vector_vec).isNotNull())
    out = None
    for b in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) if blocks > 1 else rows
        found = own.toPandas()
        sent = spark.sparkContext.broadcast((found[query_id].tolist(), _unit(found[query_vec].tolist())))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best, step = _Best(len(ids), k), max(1, min(4096, CELLS // max(1, len(ids))))
            wanted = signs(q) if signs and len(ids) else None
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    unit = _unit(part.column(1).to_pylist())
                    sims = unit @ q.T if len(ids) else np.zeros((part.num_rows, 0))
                    sims = np.round(sims, digits) if digits is not None else sims
                    if wanted is not None:
                        sims[~_sharing(signs(unit), wanted)] = -np.inf
                    best.add(np.array(part.column(0).to_pylist()), sims, np.array(part.column(2).to_pylist(), object) if carry else None)
            which, names, sims, texts = best.rows()
            columns = [pa.array([ids[j] for j in which], id_type), pa.array(names, vector_type), pa.array(sims, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * bool(carry), [query_id, vector_id, "similarity"] + [carry] * bool(carry))

        part = source.mapInArrow(run, f"`{query_id}` {types[query_id]}, `{vector_id}` {types[vector_id]}, similarity double" + (f", `{carry}` string" if carry else ""))
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), vector_id)
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(query_id, "rank", vector_id, "similarity", *([carry] if carry else []))


def _sharing(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Whether a row's buckets and a query's agree in some table."""
    out = rows[:, :1] == queries[:, 0]
    for t in range(1, rows.shape[1]):
        out |= rows[:, t : t + 1] == queries[:, t]
    return out


class _Best:
    """The k best of each query so far, by falling similarity, then by id. A portion
    adds only what reaches the query's k-th best; -inf stands for no pair."""

    def __init__(self, queries: int, k: int):
        self.k, self.edge = k, np.full(queries, np.finfo(float).min)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, names: np.ndarray, sims: np.ndarray, texts: np.ndarray | None) -> None:
        if len(sims) > self.k and sims.shape[1]:
            np.maximum(self.edge, np.partition(sims, -self.k, axis=0)[-self.k], out=self.edge)
        row, which = np.nonzero(sims >= self.edge)
        self.kept.append((which, names[row], sims[row, which], np.full(len(row), None) if texts is None else texts[row]))
        self.size += len(row)
        if self.size > 1_000_000:
            self._settle()

    def _settle(self) -> None:
        which, names, sims, texts = (np.concatenate(x) for x in zip(*self.kept))
        order = np.lexsort((names, -sims, which))
        which = which[order]
        keep = np.arange(len(which)) - np.searchsorted(which, which) < self.k
        order = order[keep]
        self.kept, self.size = [(which[keep], names[order], sims[order], texts[order])], len(order)

    def rows(self) -> tuple[list, list, list, list]:
        if not self.kept:
            return [], [], [], []
        self._settle()
        return tuple(x.tolist() for x in self.kept[0])


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(len(rows), -1 if rows else 0)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def top_k_columns(queries: DataFrame, vectors: DataFrame, on: tuple[str, ...], k: int = TOP_K, query_id: str = "query_id", vector_id: str = "chunk_id", query_vec: str = "query_embedding", vector_vec: str = "embedding", digits: int = 5) -> DataFrame:
    """As top_k(), within rows that agree in `on`, by built-in functions alone: an
    equi-join, and a window of which each task keeps k rows a query beforehand."""
    if not on:
        raise ValueError("without columns to agree in, use top_k()")
    pairs = vectors.select(vector_id, vector_vec, *on).join(queries.select(query_id, query_vec, *on), list(on))
    pairs = pairs.select(query_id, vector_id, F.round(cosine(F.col(query_vec), F.col(vector_vec)), digits).alias("similarity"))
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), vector_id)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(query_id, "rank", vector_id, "similarity")


def approximate_top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, query_id: str = "query_id", vector_id: str = "chunk_id", query_vec: str = "query_embedding", vector_vec: str = "embedding", bucket: float = 1.0, tables: int = 8, digits: int | None = None) -> DataFrame:
    """As top_k(), but only rows that share a bucket of random projections with a
    query are compared. A task finds the buckets of its own rows and holds them
    against those of the broadcast queries: neither vectors nor pairs are shuffled."""

    def signs(unit: np.ndarray) -> np.ndarray:
        lines = np.random.default_rng(7).standard_normal((tables, unit.shape[1]))
        lines /= np.sqrt((lines * lines).sum(1, keepdims=True))
        found = np.floor(unit @ lines.T / bucket)
        return found.astype(np.int8 if bucket > 0.01 else np.int64)

    return _blockwise(queries, vectors, k, (query_id, vector_id, query_vec, vector_vec), digits, None, signs)


class VectorStore:
    """Chunks with vectors, as a DataFrame that only grows until it is cleared."""

    def __init__(self, spark: SparkSession, dimensions: int = 768):
        self.spark, self.dimensions = spark, dimensions
        self.clear()

    def clear(self) -> None:
        self._rows = self.spark.createDataFrame([], "chunk_id long, chunk_index int, text string, embedding array<float>, metadata map<string,string>")
        self._next = 0

    def add_chunks(self, texts: list[str], vectors: list[list[float]], metadata: list[dict] | None = None) -> None:
        """Ids go on from those before; an id in the metadata gives way to the row's own."""
        if len(texts) != len(vectors) or metadata is not None and len(metadata) != len(texts):
            raise ValueError("as many vectors (and metadata) as texts are expected")
        rows = []
        for i, (text, vector) in enumerate(zip(texts, vectors)):
            if len(vector) != self.dimensions:
                raise ValueError(f"a vector of width {self.dimensions} is expected")
            own = {str(a): str(b) for a, b in (metadata[i] if metadata else {}).items()}
            rows.append((self._next + i, i, text, [float(x) for x in vector], own | {"chunk_id": str(self._next + i), "chunk_index": str(i)}))
        if rows:
            self._rows = self._rows.unionByName(self.spark.createDataFrame(rows, self._rows.schema))
            self._next += len(rows)

    def add_frame(self, chunks: DataFrame, order: tuple[str, ...] = ("doc_id", "chunk_index")) -> None:
        """Adds (chunk_index, text, embedding) rows; ids follow the given order."""
        ordered = chunks.orderBy(*order).select("chunk_index", "text", F.col("embedding").cast("array<float>").alias("embedding"))
        # the place within a partition and, from a count of each, where the partition begins
        placed = settled(ordered.withColumn("_at", F.monotonically_increasing_id()))
        part = F.shiftright("_at", 33)
        begins, first = [], self._next
        for r in sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r.part):
            begins.append((r.part, first))
            first += r["count"]
        if not begins:
            return
        starts = self.spark.createDataFrame(begins, "_part long, _begin long")
        rows = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
        rows = rows.select((F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("chunk_id"), "chunk_index", "text", "embedding")
        rows = rows.withColumn("metadata", F.create_map(F.lit("chunk_id"), F.col("chunk_id").cast("string"), F.lit("chunk_index"), F.col("chunk_index").cast("string")))
        self._rows = self._rows.unionByName(rows)
        self._next = first

    def frame(self) -> DataFrame:
        return self._rows

    def count(self) -> int:
        return self._rows.count()

    def stats(self) -> dict[str, int]:
        return {"chunks": self.count(), "dimensions": self.dimensions, "vector_bytes": 4 * self.dimensions * self.count()}

    def search(self, query: list[float], k: int = 3) -> DataFrame:
        """(rank, chunk_id, text, similarity, metadata) of the k nearest."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, query_embedding array<double>")
        return top_k(one, self._rows, k).join(self._rows, "chunk_id").select("rank", "chunk_id", "text", "similarity", "metadata").orderBy("rank")


def band(similarity: Column) -> Column:
    return F.when(similarity >= 0.8, "green").when(similarity >= 0.5, "yellow").otherwise("red")


def bar_filled(similarity: Column) -> Column:
    """Filled cells of a bar; none for a negative similarity."""
    return F.least(F.greatest((similarity * BAR).cast("int"), F.lit(0)), F.lit(BAR))


def bar(similarity: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), bar_filled(similarity)), F.repeat(F.lit("-"), BAR - bar_filled(similarity)))


def preview(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def result_cards(hits: DataFrame) -> DataFrame:
    """Adds filled, band, bar and preview to (…, text, similarity)."""
    s = F.col("similarity")
    return hits.withColumn("filled", bar_filled(s)).withColumn("band", band(s)).withColumn("bar", bar(s)).withColumn("preview", preview(F.col("text")))
