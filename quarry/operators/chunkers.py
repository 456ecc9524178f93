"""Chunking: one row of text becomes the rows of its chunks.

Each strategy builds one array column of structs (text, start_pos, end_pos,
unit_count) from built-in functions; exploding it is all that follows, so
chunking neither shuffles nor leaves the JVM, filters on other columns move below
it, and the text itself is not copied to the chunks' rows. Sizes are in tokens of
four characters, but for the token strategy, whose sizes are its own tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import NON_WS, WS, find, is_blank, let, split_literal, stripped_parts

CHARS_PER_TOKEN = 4
CHUNK_TYPE = "array<struct<text:string,start_pos:int,end_pos:int,unit_count:int>>"


class Strategy(Enum):
    TOKEN = "token"
    SENTENCE = "sentence"
    PARAGRAPH = "paragraph"
    RECURSIVE = "recursive"
    FIXED_CHARS = "fixed_chars"
    CUSTOM = "custom"


def check_sizes(chunk_size: int, overlap: int) -> None:
    if chunk_size < 1 or overlap < 0 or overlap >= chunk_size:
        raise ValueError("chunk_size must be positive, overlap at least 0 and less than chunk_size")


def _chunk(text: Column, start: Column, units: Column) -> Column:
    return F.struct(text.alias("text"), start.cast("int").alias("start_pos"), (start + F.length(text)).cast("int").alias("end_pos"), units.cast("int").alias("unit_count"))


def _window_count(n: Column, size: int, stride: int) -> Column:
    """Windows until one reaches the end."""
    return F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / F.lit(stride))).cast("int")


def fixed_chunks(text: Column, chunk_size: int, overlap: int) -> Column:
    size, stride = chunk_size * CHARS_PER_TOKEN, (chunk_size - overlap) * CHARS_PER_TOKEN

    def window(i: Column) -> Column:
        return let(F.substring(text, i * stride + 1, F.lit(size)), lambda part: _chunk(part, i * stride, F.length(part)))

    return F.transform(F.sequence(F.lit(0), _window_count(F.length(text), size, stride) - 1), window)


def token_chunks(text: Column, chunk_size: int, overlap: int, tokens: Column | None = None) -> Column:
    """Windows of tokens. By default a token is a word with the white space before it,
    so the tokens of a text concatenate to the text."""
    stride = chunk_size - overlap
    tokens = F.regexp_extract_all(text, F.lit(f"({WS}*{NON_WS}+|{WS}+\\z)"), F.lit(1)) if tokens is None else tokens

    def windows(t: Column) -> Column:
        start = F.struct(F.array().cast(CHUNK_TYPE).alias("out"), F.lit(0).alias("pos"))

        def step(acc: Column, i: Column) -> Column:
            own = F.slice(t, i * stride + 1, F.lit(chunk_size))
            passed = F.length(F.array_join(F.slice(t, i * stride + 1, F.lit(stride)), ""))
            return F.struct(F.concat(acc["out"], F.array(_chunk(F.array_join(own, ""), acc["pos"], F.size(own)))).alias("out"), (acc["pos"] + passed).alias("pos"))

        count = _window_count(F.size(t), chunk_size, stride)
        return F.when(F.size(t) > 0, F.aggregate(F.sequence(F.lit(0), count - 1), start, step, lambda acc: acc["out"])).otherwise(F.array().cast(CHUNK_TYPE))

    return let(tokens, windows)


_SPANS = "array<struct<first:int,n:int,pos:int>>"


def _longest_tail(widths: Column, limit: int, joiner: int) -> Column:
    """How many of the last units are carried over, and how wide they are joined: as
    many as stay under the limit before the next joiner is counted."""

    def step(acc: Column, w: Column) -> Column:
        fits = acc["open"] & (acc["width"] + w < limit)
        return F.struct(
            (acc["n"] + fits.cast("int")).alias("n"),
            (acc["width"] + F.when(fits, w + F.when(acc["n"] > 0, joiner).otherwise(0)).otherwise(0)).alias("width"),
            fits.alias("open"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("width"), F.lit(True).alias("open"))
    return F.aggregate(F.reverse(widths), start, step)


def _last_only(widths: Column, limit: int, joiner: int) -> Column:
    """The last unit, if it stays under the limit."""
    last = F.element_at(widths, -1)
    return F.struct((last < limit).cast("int").alias("n"), F.when(last < limit, last).otherwise(0).alias("width"))


def packed_chunks(units: Column, chunk_size: int, overlap: int, joiner: str, carry: Callable[[Column, int, int], Column]) -> Column:
    """Units packed greedily. The fold carries places and widths only; text is
    joined once, at the end. Widths count no joiners, but for those of a tail."""
    size, limit, gap = chunk_size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN, len(joiner)

    def pack(u: Column, widths: Column) -> Column:
        def state(out, first, n, counted, pos, joined) -> Column:
            return F.struct(out.alias("out"), first.alias("first"), n.alias("n"), counted.alias("counted"), pos.alias("pos"), joined.alias("joined"))

        def span(acc: Column) -> Column:
            return F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n"), acc["pos"].alias("pos")))

        def add(acc: Column, w: Column) -> Column:
            return state(acc["out"], acc["first"], acc["n"] + 1, acc["counted"] + w, acc["pos"], acc["joined"] + w + F.when(acc["n"] > 0, gap).otherwise(0))

        def emit(acc: Column) -> Column:
            out = F.concat(acc["out"], span(acc))
            if limit == 0:
                return state(out, acc["first"] + acc["n"], F.lit(0), F.lit(0), acc["pos"] + acc["joined"], F.lit(0))
            tail = carry(F.slice(widths, acc["first"] + 1, acc["n"]), limit, gap)
            return let(tail, lambda t: state(out, acc["first"] + acc["n"] - t["n"], t["n"], t["width"], acc["pos"] + acc["joined"] - t["width"], t["width"]))

        def step(acc: Column, w: Column) -> Column:
            full = (acc["n"] > 0) & (acc["counted"] + w > size)
            return let(F.when(full, emit(acc)).otherwise(acc), lambda a: add(a, w))

        zero = F.lit(0)
        start = state(F.array().cast(_SPANS), zero, zero, zero, zero, zero)
        spans = F.aggregate(widths, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], span(acc))).otherwise(acc["out"]))
        return F.transform(spans, lambda s: let(F.array_join(F.slice(u, s["first"] + 1, s["n"]), joiner), lambda part: _chunk(part, s["pos"], s["n"])))

    return let(units, lambda u: let(F.transform(u, F.length), lambda widths: pack(u, widths)))


def sentence_chunks(text: Column, chunk_size: int, overlap: int) -> Column:
    return packed_chunks(stripped_parts(text, f"(?<=[.!?]){WS}+"), chunk_size, overlap, " ", _longest_tail)


def paragraph_chunks(text: Column, chunk_size: int, overlap: int) -> Column:
    return packed_chunks(stripped_parts(text, f"\n{WS}*\n"), chunk_size, overlap, "\n\n", _last_only)


#: Tried in this order; beyond the last, text is cut by characters.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _split_level(text: Column, level: int, size: int, stride: int) -> Column:
    """Parts of a text by the separators from `level` on, as nested folds that are
    unrolled when the plan is built."""
    if level == len(SEPARATORS):
        cut = F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride)), lambda i: F.substring(text, i + 1, F.lit(size)))
        return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))
    separator = SEPARATORS[level]

    def fold(parts: Column) -> Column:
        def state(out, at, first, n, counted) -> Column:
            return F.struct(out.alias("out"), at.alias("at"), first.alias("first"), n.alias("n"), counted.alias("counted"))

        def joined(acc: Column) -> Column:
            return F.array(F.array_join(F.slice(parts, acc["first"] + 1, acc["n"]), separator))

        def take(acc: Column, part: Column) -> Column:
            first = F.when(acc["n"] == 0, acc["at"]).otherwise(acc["first"])
            small = state(acc["out"], acc["at"] + 1, first, acc["n"] + 1, acc["counted"] + F.length(part) + len(separator))
            large = state(F.concat(acc["out"], _split_level(part, level + 1, size, stride)), acc["at"] + 1, acc["at"] + 1, F.lit(0), F.lit(0))
            return F.when(F.length(part) > size, large).otherwise(small)

        def step(acc: Column, part: Column) -> Column:
            full = (acc["n"] > 0) & (acc["counted"] + F.length(part) > size)
            flushed = state(F.concat(acc["out"], joined(acc)), acc["at"], acc["at"], F.lit(0), F.lit(0))
            return let(F.when(full, flushed).otherwise(acc), lambda a: take(a, part))

        zero = F.lit(0)
        start = state(F.array().cast("array<string>"), zero, zero, zero, zero)
        return F.aggregate(parts, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], joined(acc))).otherwise(acc["out"]))

    return let(split_literal(text, separator), fold)


def recursive_chunks(text: Column, chunk_size: int, overlap: int) -> Column:
    """Parts by ever finer separators. A part is looked for in the text from the end
    of the one before; where it isn't found it is taken to begin there."""
    size, stride = chunk_size * CHARS_PER_TOKEN, (chunk_size - overlap) * CHARS_PER_TOKEN

    def place(acc: Column, part: Column) -> Column:
        return let(
            let(find(text, part, acc["pos"]), lambda at: F.when(at < 0, acc["pos"]).otherwise(at)),
            lambda start: F.struct(F.concat(acc["out"], F.array(_chunk(part, start, F.lit(None)))).alias("out"), (start + F.length(part)).cast("int").alias("pos")),
        )

    start = F.struct(F.array().cast(CHUNK_TYPE).alias("out"), F.lit(0).alias("pos"))
    return F.aggregate(_split_level(text, 0, size, stride), start, place, lambda acc: acc["out"])


@dataclass(frozen=True)
class StrategyInfo:
    strategy: Strategy
    unit_kind: str | None
    description: str
    build: Callable[[Column, int, int], Column] | None


#: Built-in strategies; register() adds others of the same form.
REGISTRY: dict[str, StrategyInfo] = {
    s.value: StrategyInfo(s, kind, about, build)
    for s, kind, about, build in (
        (Strategy.TOKEN, "token", "Windows of a number of tokens", token_chunks),
        (Strategy.SENTENCE, "sentence", "Whole sentences, packed up to the size", sentence_chunks),
        (Strategy.PARAGRAPH, "paragraph", "Whole paragraphs, packed up to the size", paragraph_chunks),
        (Strategy.RECURSIVE, None, "The coarsest separators that give parts within the size", recursive_chunks),
        (Strategy.FIXED_CHARS, "char", "Windows of a number of characters", fixed_chunks),
        (Strategy.CUSTOM, None, "A Python function of your own", None),
    )
}
ALIASES = {"fixed": "fixed_chars"}


def register(name: str, build: Callable[[Column, int, int], Column], unit_kind: str | None = None, description: str = "") -> None:
    """Adds a strategy: a function of (text, chunk_size, overlap) columns that gives
    an array of (text, start_pos, end_pos, unit_count)."""
    REGISTRY[name] = StrategyInfo(Strategy.CUSTOM, unit_kind, description, build)


def get_strategy(name: str | Strategy) -> StrategyInfo:
    key = name.value if isinstance(name, Strategy) else ALIASES.get(name, name)
    if key not in REGISTRY:
        raise ValueError(f"unknown strategy: {name}")
    return REGISTRY[key]


def strategies(spark: SparkSession) -> DataFrame:
    """The catalogue: (type, name, description)."""
    rows = [(i.strategy.value, name, i.description) for name, i in REGISTRY.items()]
    return spark.createDataFrame(rows, "type string, name string, description string")


def custom_chunks(df: DataFrame, function: Callable, chunk_size: int, overlap: int, text_col: str, id_cols: tuple[str, ...]) -> DataFrame:
    """Rows of a Python function's chunks. Tuples of three or more are (text, start,
    end[, metadata]); anything else is taken as text and looked up in the input."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)

    def chunks(text: str) -> Iterator[tuple]:
        items = list(function(text, chunk_size, overlap))
        placed = []
        for item in items:
            if isinstance(item, tuple) and len(item) >= 3:
                metadata = item[3] if len(item) > 3 else {}
                placed.append((str(item[0]), int(item[1]), int(item[2]), {str(k): str(v) for k, v in (metadata or {}).items()}))
            else:
                part = str(item)
                at = text.find(part)
                placed.append((part, at, at + len(part), {}))
        for i, row in enumerate(placed):
            yield (i, *row, placed[i + 1][1] if i + 1 < len(placed) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.int32())
        names = ("chunk_index", "text", "start_pos", "end_pos", "metadata", "next_start")
        for batch in batches:
            rows, own = [], []
            for k, text in enumerate(batch.column("_text").to_pylist()):
                for row in chunks(text):
                    rows.append(row)
                    own.append(k)
            columns = list(zip(*rows)) or [()] * len(types)
            ids = [batch.column(c).take(pa.array(own, pa.int64())) for c in id_cols]
            made = [pa.array(list(map(lambda m: list(m.items()), v)) if pa.types.is_map(t) else list(v), t) for v, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*ids, *made], [*id_cols, *names])

    schema = f"{fields}, chunk_index int, text string, start_pos int, end_pos int, metadata map<string,string>, next_start int"
    rows = df.filter(~is_blank(F.col(text_col))).select(*id_cols, F.col(text_col).alias("_text"))
    out = rows.mapInArrow(run, schema).withColumn("unit_kind", F.lit(None).cast("string")).withColumn("unit_count", F.lit(None).cast("int"))
    return out.select(*id_cols, "chunk_index", "text", "start_pos", "end_pos", "unit_kind", "unit_count", "next_start", "metadata")


def chunk(
    df: DataFrame, strategy: str | Strategy = Strategy.TOKEN, chunk_size: int = 200, overlap: int = 20, *,
    text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), function: Callable | None = None, drop_blank: bool = False,
) -> DataFrame:
    """(id columns, chunk_index, text, start_pos, end_pos, unit_kind, unit_count,
    next_start) of every chunk; null and blank texts have none.

    next_start is where the document's next chunk begins (null for the last), so
    overlaps need no window over the chunks. `drop_blank` leaves out chunks of white
    space, which the recursive strategy can give; indexes then keep their gaps.
    """
    check_sizes(chunk_size, overlap)
    info = get_strategy(strategy)
    if function is not None or info.build is None:
        if function is None:
            raise ValueError("the custom strategy needs a function")
        out = custom_chunks(df, function, chunk_size, overlap, text_col, id_cols)
    else:
        rows = df.filter(~is_blank(F.col(text_col))).select(*id_cols, F.col(text_col).alias("_text"))
        rows = rows.select(*id_cols, info.build(F.col("_text"), chunk_size, overlap).alias("_chunks"))
        starts = F.transform("_chunks", lambda c, i: F.struct(c.alias("c"), F.get("_chunks", i + 1)["start_pos"].alias("next")))
        rows = rows.select(*id_cols, F.posexplode(starts).alias("chunk_index", "_c"))
        out = rows.select(*id_cols, "chunk_index", "_c.c.text", "_c.c.start_pos", "_c.c.end_pos", F.lit(info.unit_kind).cast("string").alias("unit_kind"), "_c.c.unit_count", F.col("_c.next").alias("next_start"))
    return out.filter(~is_blank(F.col("text"))) if drop_blank else out
