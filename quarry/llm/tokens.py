"""Token counts: a two-tier lookup of pre-token lengths.

The first tier is a compact table of frequent pre-tokens, broadcast; it is made from a
bounded sample, as it is a matter of speed alone. The second tier is each worker's
cache, filled by the tokenizer itself. Pre-tokens are never shuffled: counting is one
pass over the texts without an exchange.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN
from .common import slices, whole_text

#: Entries of the broadcast table, and its longest pre-token in bytes: a bound on its size.
FREQUENT, LONGEST = 50_000, 64
#: Texts of the sample, the first ones of up to so many bytes: 64 MB on the driver at the utmost.
SAMPLED, SAMPLED_BYTES = 4_000, 16 << 10
#: Bytes of a worker's cache in each of two generations, what an entry takes besides its
#: string, and bytes of text that a worker counts at a time.
CACHE_BYTES, ENTRY_BYTES, PORTION = 96 << 20, 130, 4 << 20


def cut_at_space(spec: dict) -> bool:
    """Whether a `.json` file surely treats words between ASCII white space apart: its
    steps drop or keep white space as a border and its added tokens are plain strings."""
    parts = lambda step, key: [] if step is None else [x for s in step[key] for x in parts(s, key)] if step["type"] == "Sequence" else [step]
    for step in parts(spec.get("normalizer"), "normalizers"):
        if step["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents") and not (step["type"] == "Replace" and step["pattern"].get("Regex") == "\\s+" and step["content"] == " "):
            return False
    first = next(iter(parts(spec.get("pre_tokenizer"), "pretokenizers")), {"type": None})
    words = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") == PATTERN
    apart = words or first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return apart and plain and (spec.get("post_processor") or {}).get("type") in (None, "ByteLevel", "TemplateProcessing", "BertProcessing", "RobertaProcessing")


class Counts:
    """Token counts with one vocabulary file.

    Pre-tokens are the words between ASCII white space where the file is known to cut
    there. Other `.json` files and `.model` files have no such cut: there the whole
    text is counted by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words, self.pieces = False, not path.endswith(".json")
        if self.pieces:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            with open(path, encoding="utf-8") as f:
                self.words = cut_at_space(json.load(f))
        self.kept: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.held = 0

    def lengths(self, pieces: list[bytes]) -> list[int]:
        texts = [p.decode("utf-8") for p in pieces]
        if self.pieces:
            return [len(ids) for ids in self.library.encode(texts, num_threads=1)] if texts else []
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, texts: list[bytes], table: dict[bytes, int]) -> list[int]:
        """Token counts of whole texts. A full cache becomes the older one; its words
        come back as they are asked for."""
        if not self.words:
            return self.lengths(texts)
        if not self.kept or self.held > CACHE_BYTES:
            self.older, self.kept, self.held = self.kept, dict(table), 0
        kept, older, split = self.kept, self.older, [t.split() for t in texts]
        new = [w for w in set().union(*split) if w not in kept]
        lacking = [w for w in new if w not in older]
        kept.update(zip(lacking, self.lengths(lacking)))
        kept.update((w, older[w]) for w in new if w in older)
        self.held += sum(map(len, new)) + ENTRY_BYTES * len(new)
        get = kept.__getitem__
        return [sum(map(get, words)) for words in split]


_COUNTS: dict[str, Counts] = {}


def counter(path: str) -> Counts:
    if path not in _COUNTS:
        _COUNTS[path] = Counts(path)
    return _COUNTS[path]


def frequent_pretokens(df: DataFrame, text_col: str = "text", most: int = FREQUENT) -> list[bytes]:
    """The `most` most frequent pre-tokens of a bounded sample: the first SAMPLED texts
    of at most SAMPLED_BYTES, which takes no pass over the table."""
    texts = df.select(whole_text(text_col).alias("t")).filter(F.octet_length("t") <= SAMPLED_BYTES).limit(SAMPLED).collect()
    seen: Counter = Counter()
    for r in texts:
        seen.update(r.t.encode("utf-8").split())
    return [w for w, _ in seen.most_common() if len(w) <= LONGEST][:most]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, n_bytes long, n_tokens long) of every whole text.

    Counts equal the library's without begin, end or added special tokens,
    truncation or padding. Null and empty texts have 0 tokens; a very long text is a
    portion of its own; repeated rows and null ids are kept; other columns are left
    out; an empty table gives none.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    counts = Counts(path)
    top = frequent_pretokens(df, text_col, frequent) if counts.words else []
    sent = spark.sparkContext.broadcast(dict(zip(top, counts.lengths(top))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for part in slices(batch, "_text", PORTION):
                texts = part.column("_text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(map(len, texts), pa.int64()), pa.array(counts.of(texts, sent.value), pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
