"""WARC archives with a two-level capture index.

Every record is a gzip member of its own. Captures are sorted by reversed-host
URL keys into compressed blocks; a sparse directory has the first key of each
block. A look-up searches the directory, range-reads the blocks that can hold the
key, searches them, and range-reads the records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices

#: Captures of an index block, and blocks that a task reads at the utmost.
BLOCK_LINES, BLOCKS = 1000, 50
#: gzip level of records and blocks.
LEVEL = 3
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The reversed-host key: com,example,www)/path?query, without scheme, user and fragment."""
    if not url:
        return ")/"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return f"){quote(url.strip(), safe='/:?=&%')}"
    host = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _address(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(address: str) -> int | None:
    number = address.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit leaves the payload out but keeps its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_address(page_id)}", f"WARC-Date: {date}"]
    if url:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_address(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record. ValueError: it is cut off."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if len(block) < int(headers["Content-Length"]):
        raise ValueError("the record is cut off")
    return headers, block


def read_record(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """(page_id, payload bytes, digest, type, refers_to, payload) of a record; the
    payload of a response is held against its digest."""
    headers, block = parse_record(data)
    page, said = _page(headers["WARC-Record-ID"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "revisit":
        return page, int(headers["X-Payload-Length"]), said, "revisit", _page(headers["WARC-Refers-To"]), None
    payload = block.partition(b"\r\n\r\n")[2]
    if digest(payload) != said:
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} has another digest")
    return page, len(payload), said, "response", None, payload


def resolved(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it: without one it lies in the default
    file system, which all executors share, and not on an executor's own disk."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Appender:
    """A file of members that is opened at the first one, and closed whatever happens."""

    def __init__(self, path: str, folder: str, ending: str):
        self.system, self.root = _open(path)
        self.system.create_dir(f"{self.root}/{folder}", recursive=True)
        self.name, self.at, self.out = f"{folder}/{uuid.uuid4().hex}{ending}", 0, None

    def add(self, data: bytes) -> tuple[int, int]:
        """Appends a gzip member; its offset and length."""
        member = gzip.compress(data, LEVEL, mtime=0)
        if self.out is None:
            self.out = self.system.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(member)
        self.at += len(member)
        return self.at - len(member), len(member)

    def __enter__(self) -> _Appender:
        return self

    def __exit__(self, *_) -> None:
        if self.out is not None:
            self.out.close()


_CAPTURE = "url_key string, page_id long, record_type string, file string, offset long, length long"


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, revisit, refers_to): of equal payloads of `least` bytes or
    more the largest page_id is the response. The largest id of a payload is found
    by an aggregate with map-side maximum; the join back can split a hot payload."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("d", F.sha1(F.col("html").cast("binary")))
    first = rows.groupBy("d").agg(F.max("page_id").alias("first"))
    joined = rows.join(first, "d")
    revisit = F.coalesce((F.col("first") != F.coalesce("page_id", F.col("first") - 1)) & (F.octet_length("html") >= least), F.lit(False))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = "2000-01-01T00:00:00Z", block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes a record for every row of (page_id, url, html) and the index, below
    `path`, a folder that all executors share. Returns the directory.

    A task writes files of its own, under new names at each attempt; the index
    lists those of successful attempts only. Null html is an empty payload, a null
    url has the key ")/", repeated rows have records of their own, rows of one
    payload and the largest page_id are all responses, a null page_id counts as
    the smallest; a very long payload is one record, compressed by itself; other
    columns are left out; an empty table gives an empty index.
    """
    spark, at = pages.sparkSession, resolved(pages.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Appender(at, "archive", ".warc.gz") as out:
            for batch in batches:
                for part in slices(batch, "html"):
                    found = []
                    for page, url, html, revisit, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to"))):
                        place = out.add(record(page, url, html.encode(), refers, revisit, date))
                        found.append((url_key(url), page, "revisit" if revisit else "response", out.name, *place))
                    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), types)], ["url_key", "page_id", "record_type", "file", "offset", "length"])

    captures = cut(plan_records(pages, least).mapInArrow(write, _CAPTURE))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []
        made: list[tuple] = []
        first = ""
        with _Appender(at, "index", ".cdx.gz") as out:

            def close_block() -> None:
                made.append((first, out.name, *out.add("".join(lines).encode()), len(lines)))
                lines.clear()

            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "record_type", "file", "offset", "length"))):
                    first = first if lines else row[0]
                    lines.append("\t".join("" if v is None else str(v).replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D") for v in row) + "\n")
                    if len(lines) == block_lines:
                        close_block()
            if lines:
                close_block()
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*made)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], ["first_key", "file", "offset", "length", "captures"])

    # the file's and record's place breaks ties, so that captures of one hot key are dealt out as well
    ordered = captures.repartitionByRange("url_key", "file", "offset").sortWithinPartitions("url_key", "file", "offset")
    directory = ordered.mapInArrow(blocks, "first_key string, file string, offset long, length long, captures long")
    directory.write.mode("overwrite").parquet(f"{path}/directory")
    return spark.read.parquet(f"{path}/directory")


class _Ranges:
    """Range reads, with the last few files kept open."""

    def __init__(self, path: str):
        self.system, self.root = _open(path)
        self.files: dict[str, pa.NativeFile] = {}

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.files:
            if len(self.files) > 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[file] = self.system.open_input_file(f"{self.root}/{file}")
        return zlib.decompress(self.files[file].read_at(length, offset), 31)

    def captures(self, file: str, offset: int, length: int) -> list[list[str]]:
        return [line.split("\t") for line in self.read(file, offset, length).decode().split("\n")[:-1]]


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string"


def _rows(found: list[tuple], payloads: bool) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key"] + ["payload"] * payloads
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads
    columns = list(zip(*found)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names)


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every capture that the index lists, read from its archive: (page_id,
    payload_bytes, payload_digest, record_type, refers_to, url_key), and with
    `payloads` the payload (null for a revisit). A task takes some blocks."""

    at = resolved(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(at)
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                found = []
                for key, _, _, name, start, size in sorted(ranges.captures(file, offset, length), key=lambda c: (c[3], int(c[4]))):
                    r = read_record(ranges.read(name, int(start), int(size)))
                    found.append((*r[:5], key, *([r[5]] if payloads else [])))
                yield _rows(found, payloads)

    directory = spark.read.parquet(f"{path}/directory").select("file", "offset", "length")
    # a row is a block of records: dealt out evenly, a few tasks a core, or more of BLOCKS each
    n = directory.count()
    tasks = max(1, min(n, max(3 * spark.sparkContext.defaultParallelism, -(-n // BLOCKS))))
    return directory.repartition(tasks).mapInArrow(run, _READ + ", payload binary" * payloads)


def look_up(spark: SparkSession, path: str, urls: list[str]) -> DataFrame:
    """The captures of the given URLs, with payloads. Each part of the directory is
    searched for the blocks that can hold a key: the last that begins below it
    and those that begin with it. Blocks are searched in the same way."""
    keys, at = sorted({url_key(u) for u in urls}), resolved(spark, path)
    sent = spark.sparkContext.broadcast(keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("first_key", "file", "offset", "length"))))
            firsts, found = [r[0] for r in rows], []
            for key in sent.value:
                at = bisect_left(firsts, key)
                low = bisect_left(firsts, firsts[at - 1]) if at else 0
                found += [(key, *r) for r in rows[low : bisect_right(firsts, key)]]
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*found)) or [()] * 5, types)], ["key", "first_key", "file", "offset", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(at)
        for batch in batches:
            found = []
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length"))):
                lines = ranges.captures(file, offset, length)
                have = [line[0] for line in lines]
                for line in lines[bisect_left(have, key) :]:
                    if line[0] != key:
                        break
                    r = read_record(ranges.read(line[3], int(line[4]), int(line[5])))
                    found.append((*r[:5], key, r[5]))
            yield _rows(found, True)

    places = spark.read.parquet(f"{path}/directory").mapInArrow(search, "key string, first_key string, file string, offset long, length long")
    under = places.filter("first_key < key")
    # blocks may begin alike: all that share the last first key below can hold the key
    last = under.groupBy("key").agg(F.max("first_key").alias("m"))
    below = under.join(last, "key").filter("first_key = m").select("key", "file", "offset", "length")
    blocks = below.unionByName(places.filter("first_key = key").select("key", "file", "offset", "length"))
    return blocks.mapInArrow(fetch, _READ + ", payload binary")
