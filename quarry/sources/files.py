"""Files as a table: content, encoding and size figures; PDF by an extractor of your own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarry.functions.text import strip, universal_newlines

# The extensions that are read, and what they stand for.
EXTENSIONS = {
    ".txt": "Plain text", ".md": "Markdown", ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".xml": "XML",
    ".html": "HTML", ".css": "CSS", ".sql": "SQL", ".sh": "Shell", ".rst": "reStructuredText", ".tex": "LaTeX", ".csv": "CSV", ".pdf": "PDF Document",
}


def extension(path: Column) -> Column:
    """The lower-cased suffix of a path, with its dot; "" without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def decoded(content: Column) -> tuple[Column, Column]:
    """Text and the name of its encoding: UTF-8 if the bytes are, else Latin-1, which
    takes any bytes. Line ends become newlines."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    text = F.when(utf8, content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return universal_newlines(text), F.when(utf8, F.lit("utf-8")).otherwise(F.lit("latin-1"))


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def pdf_text(pages: list[str]) -> tuple[str, int]:
    """Pages with text under a heading each, and the number of all pages."""
    return "\n\n".join(f"--- Page {i} ---\n{text}" for i, text in enumerate(pages, 1) if text), len(pages)


def extract_with_pypdf(content: bytes) -> list[str]:
    """The pages' texts, where that package is installed."""
    import io

    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def read_files(spark: SparkSession, path: str | list[str], strict: bool = False, extract_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(content, path, name, extension, size_bytes, line_count, char_count, encoding,
    page_count) a file. Files of other extensions are left out, or with `strict` an
    error. A missing path is FileNotFoundError.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(path) from problem
        raise
    return describe_files(files.select("path", "length", "content"), strict, extract_pages)


def describe_files(files: DataFrame, strict: bool = False, extract_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """As read_files(), of rows (path, length, content binary) from any source."""
    files = files.select("path", F.col("length").alias("size_bytes"), "content", extension(F.col("path")).alias("extension"))
    known = F.col("extension").isin(*EXTENSIONS)
    if strict:
        files = files.withColumn("extension", F.when(known, F.col("extension")).otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), F.col("extension")))))
    else:
        files = files.filter(known)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    text, encoding = decoded(F.col("content"))
    plain = files.filter(F.col("extension") != ".pdf").select(text.alias("content"), "path", "extension", "size_bytes", encoding.alias("encoding"), F.lit(0).alias("page_count"))
    pdfs = files.filter(F.col("extension") == ".pdf")
    extract = extract_pages or extract_with_pypdf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [pdf_text(extract(bytes(c))) for c in pdf["content"]]
            yield pd.DataFrame({"content": [t for t, _ in both], "path": pdf["path"], "extension": pdf["extension"], "size_bytes": pdf["size_bytes"], "encoding": "pdf", "page_count": [n for _, n in both]})

    read = pdfs.mapInPandas(run, "content string, path string, extension string, size_bytes long, encoding string, page_count int")
    out = plain.unionByName(read)
    return out.select("content", "path", name.alias("name"), "extension", "size_bytes", line_count(F.col("content")).alias("line_count"), F.length("content").alias("char_count"), "encoding", "page_count")


def parse_queries(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(other columns, pos, query): a query a line, stripped, blanks left out, in order."""
    others = [c for c in df.columns if c != text_col]
    lines = df.select(*others, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    return lines.select(*others, "pos", strip(F.col("line")).alias("query")).filter(F.length("query") > 0)


SAMPLE = (
    "Retrieval works on passages, not on whole books. A passage that is too long hides its point; one that is too short loses it.",
    "Sentences are the smallest pieces that usually make sense alone. Packing a few of them keeps a thought together.",
    "Paragraphs follow the author's own plan. They differ in length a great deal, so a limit is still needed.",
    "Overlap repeats the end of one passage at the start of the next. It costs space, and saves what lies on the border.",
    "Measure before you choose. A handful of questions with known answers tells more than any rule of thumb.",
)


def sample_documents(spark: SparkSession) -> DataFrame:
    """(doc_id, text): one document of five paragraphs to begin with."""
    return spark.createDataFrame([(1, "\n\n".join(SAMPLE))], "doc_id long, text string")
