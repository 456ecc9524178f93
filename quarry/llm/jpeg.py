"""Media columns: baseline JPEG in numpy.

Reading parses the markers, Huffman-decodes the scans and reconstructs luminance
thumbnails from the DC coefficients alone. Scans are decoded in lockstep: every
restart interval of every image is a lane, and one step decodes one symbol of
all lanes at once.

Writing stores bytes as grey blocks, one block a byte, so that the thumbnail is
the payload. The DC code of category c has 9 - c bits and takes c more, the end
of block has one: 10 bits a block, and a row of 64 blocks is a restart interval.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, slices, whole_text

ROW = 64
#: Block rows of a frame: a JPEG has 65,535 lines at most. Longer payloads take several frames.
FRAME_ROWS = 8191
#: Bytes that a worker codes at a time; numpy needs some forty times as many for a moment.
PORTION = 1 << 20


# -- writing -------------------------------------------------------------------


def _dc_codes() -> np.ndarray:
    """10-bit codes of the differences -255..255, at difference + 255."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = (1 << (9 - c)) - 2  # 0, 10, 110, ... of 1, 2, 3, ... bits
        extra = (d if d >= 0 else d + (1 << c) - 1) & ((1 << c) - 1)
        out[d + 255] = (prefix << c | extra) << 1
    return out


_CODES = _dc_codes()


def _header(rows: int) -> bytes:
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xDB, bytes([0] + [8] * 64)),
            segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
            segment(0xC4, bytes([0x00, *[1] * 9, *[0] * 7, *range(8, -1, -1)])),
            segment(0xC4, bytes([0x10, 1, *[0] * 15, 0])),
            segment(0xDD, struct.pack(">H", ROW)),
            segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def write_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One stored form for each payload; all are positive multiples of ROW bytes."""
    n = len(data) // ROW
    firsts = offsets // ROW
    last = np.zeros(n, bool)
    last[firsts[1:] - 1] = True
    in_frame = (np.arange(n) - np.repeat(firsts[:-1], np.diff(firsts))) % FRAME_ROWS
    mark = np.where(last | (in_frame == FRAME_ROWS - 1), 0xD9, 0xD0 + in_frame % 8).astype(np.uint8)
    bodies, sizes = [], []
    for a in range(0, n, PORTION // ROW):
        body, size = _rows(data[a * ROW : a * ROW + PORTION].reshape(-1, ROW), mark[a : a + PORTION // ROW])
        bodies.append(body)
        sizes.append(size)
    body, ends = b"".join(bodies), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        parts = []
        for start in range(a, b, FRAME_ROWS):
            stop = min(b, start + FRAME_ROWS)
            parts += [_header(stop - start), body[ends[start] : ends[stop]]]
        out.append(b"".join(parts))
    return out


def _rows(samples: np.ndarray, mark: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Rows of blocks, each followed by its marker, and their sizes."""
    samples = samples.astype(np.int16)
    diff = np.empty_like(samples)
    diff[:, 0] = samples[:, 0] - 128
    np.subtract(samples[:, 1:], samples[:, :-1], out=diff[:, 1:])
    code = _CODES[diff + 255].reshape(-1, ROW // 4, 4)
    word = code[..., 0] << np.uint64(30) | code[..., 1] << np.uint64(20) | code[..., 2] << np.uint64(10) | code[..., 3]
    lanes = np.empty((len(samples), ROW // 4 * 5 + 2), np.uint8)
    lanes[:, :-2] = word.astype(">u8").view(np.uint8).reshape(len(samples), ROW // 4, 8)[:, :, 3:].reshape(len(samples), -1)
    lanes[:, -2], lanes[:, -1] = 0xFF, mark
    full = lanes[:, :-2] == 0xFF
    where = np.flatnonzero(lanes.reshape(-1) == 0xFF)
    where = where[where % lanes.shape[1] < lanes.shape[1] - 2]
    return np.insert(lanes.reshape(-1), where + 1, 0).tobytes(), lanes.shape[1] + full.sum(1)


def pad(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads: each text with bytes 0 up to a positive multiple of ROW."""
    sizes = np.diff(offsets)
    whole = np.maximum(ROW, -(-sizes // ROW) * ROW)
    to = np.concatenate([[0], np.cumsum(whole)])
    out = np.zeros(to[-1], np.uint8)
    shift = np.repeat(to[:-1] - offsets[:-1], sizes)
    out[np.arange(len(data)) + shift] = data
    return out, to


# -- reading -------------------------------------------------------------------


@dataclass
class Frame:
    """What the markers of one image say; `scan` is the entropy-coded part that has the
    first component, luminance: with all others, or alone."""

    image: int
    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quant: dict[int, int] = field(default_factory=dict)  # the DC entry of each table
    huff: dict[int, bytes] = field(default_factory=dict)  # 16 counts and the symbols
    restart: int = 0
    order: tuple = ()  # (DC table, AC table, component) of each block of an MCU
    interval: int = 0  # MCUs between restarts in the scan
    alone: bool = False
    scan: tuple[int, int] = (0, 0)

    @property
    def h_max(self) -> int:
        return max(p[1] for p in self.parts)

    @property
    def v_max(self) -> int:
        return max(p[2] for p in self.parts)

    def mcus(self) -> tuple[int, int]:
        """MCUs of the scan across and down; of one component alone these are its blocks."""
        h, v = self.parts[0][1:3] if self.alone else (1, 1)
        return -(-self.width * h // (8 * self.h_max)), -(-self.height * v // (8 * self.v_max))


def _scan_end(data: bytes, at: int) -> int:
    """Where entropy-coded bytes end: at a marker that is neither a stuffed byte nor a restart."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the scan is cut off")
        if data[at + 1] != 0xFF and data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 1 if data[at + 1] == 0xFF else 2


_STARTS = bytes.fromhex("c1c2c3c5c6c7c9cacbcdcecf")


def parse(data: bytes, image: int = 0) -> list[Frame]:
    """The images that follow each other in `data`. ValueError: not baseline JPEG."""
    out, at, frame = [], 0, None
    while at < len(data):
        if data[at] != 0xFF or at + 1 >= len(data):
            raise ValueError("marker expected")
        marker = data[at + 1]
        at += 2
        if marker == 0xD8:
            frame = Frame(image)
            continue
        if marker == 0xD9 and frame is not None:
            if not frame.order:
                raise ValueError("no scan with luminance")
            out.append(frame)
            frame = None
            continue
        if marker in (0xD9, 0xFF, 0x01) or frame is None:
            if marker != 0xD9 and frame is None:
                raise ValueError("no start of image")
            at -= marker == 0xFF
            continue
        if at + 2 > len(data):
            raise ValueError("cut off")
        size = data[at] << 8 | data[at + 1]
        body = data[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                frame.quant[body[k] & 15] = body[k + 1] << 8 | body[k + 2] if wide else body[k + 1]
                k += 1 + 64 * (1 + bool(wide))
        elif marker == 0xC0:
            bits, frame.height, frame.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not frame.width or not frame.height:
                raise ValueError("8-bit samples and a size are expected")
            frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in _STARTS:
            raise ValueError("not baseline")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                frame.huff[body[k]] = bytes(body[k + 1 : k + 17 + n])
                k += 17 + n
        elif marker == 0xDD:
            frame.restart = body[0] << 8 | body[1]
        elif marker == 0xDA:
            named = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if not frame.parts or not set(named) <= {p[0] for p in frame.parts}:
                raise ValueError("a scan of the frame's components is expected")
            end = _scan_end(data, at)
            if frame.parts[0][0] in named and not frame.order:
                if 1 < len(named) < len(frame.parts):
                    raise ValueError("luminance alone or with all other components is expected")
                frame.alone, frame.interval, frame.scan = len(named) == 1, frame.restart, (at, end)
                order = []
                for i, (c, h, v, _) in enumerate(frame.parts[: len(named)]):
                    t = named[c]
                    order += [(frame.huff[t >> 4], frame.huff[0x10 | t & 15], i)] * (1 if frame.alone else h * v)
                frame.order = tuple(order)
            at = end
    if frame is not None:
        raise ValueError("the image is cut off")
    if not out:
        raise ValueError("no image")
    return out


_LOOKUP: dict[tuple[bytes, bool], tuple[np.ndarray, ...]] = {}


def _lookup(table: bytes, dc: bool) -> tuple[np.ndarray, ...]:
    """By the next 16 bits: bits of code and value, the symbol, bits of the value,
    and the value where all of it lies in these bits. No code: 0 bits."""
    key = (table, dc)
    if key not in _LOOKUP:
        size, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code, k = 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                a = code << (16 - length)
                size[a : a + (1 << (16 - length))] = length
                symbol[a : a + (1 << (16 - length))] = table[k]
                code, k = code + 1, k + 1
            code <<= 1
        extra = symbol if dc else symbol & 15
        bits, window = size + extra, np.arange(1 << 16)
        low = np.where(bits <= 16, window >> np.maximum(0, 16 - bits), 0) & ((1 << extra) - 1)
        value = np.where((extra > 0) & (low < (1 << np.maximum(extra - 1, 0))), low - (1 << extra) + 1, low)
        _LOOKUP[key] = np.where(size > 0, bits, 0), symbol, extra, value, size
    return _LOOKUP[key]


def _lanes(data: bytes, frames: list[Frame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all scans without stuffing and restart markers; the
    lanes' first bytes in them, and the lanes of each frame (len + 1)."""
    buf = np.frombuffer(b"".join([data[a:b] for a, b in (f.scan for f in frames)]), np.uint8)
    begins = np.concatenate([[0], np.cumsum([f.scan[1] - f.scan[0] for f in frames])])
    keep = np.ones(len(buf), bool)
    ff = np.flatnonzero(buf[:-1] == 0xFF)
    then = buf[ff + 1]
    keep[ff[then == 0] + 1] = False
    marks = ff[(then >= 0xD0) & (then <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    firsts = np.sort(np.concatenate([begins[:-1], marks + 2]))
    upto = np.concatenate([[0], np.cumsum(keep)])
    return np.concatenate([buf[keep], np.zeros(16, np.uint8)]), upto[firsts], np.searchsorted(firsts, begins)


def thumbnails(data: bytes, frames: list[Frame]) -> list[np.ndarray]:
    """The luminance of each frame's blocks, 0 to 255, from DC coefficients.
    Scans lie in `data`; frames with the same tables are decoded together."""
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault((f.order, f.interval > 0), []).append(i)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(frames)
    for (order, _), members in groups.items():
        own = [frames[i] for i in members]
        buf, first, of_frame = _lanes(data, own)
        total = np.array([f.mcus()[0] * f.mcus()[1] for f in own])
        lanes_of = np.diff(of_frame)
        step = np.array([f.interval or t for f, t in zip(own, total.tolist())])
        if (lanes_of < -(-total // step)).any():
            raise ValueError("a restart interval is missing")
        lane = np.arange(of_frame[-1]) - np.repeat(of_frame[:-1], lanes_of)
        left = np.clip(np.repeat(total, lanes_of) - lane * np.repeat(step, lanes_of), 0, np.repeat(step, lanes_of))
        luma = sum(o[2] == 0 for o in order)
        most = int(left.max())
        start = np.concatenate([[0], np.cumsum(left)])
        dc = np.zeros((start[-1], luma), np.int32)
        position = first.astype(np.int64) * 8
        predicted = np.zeros((1 + max(o[2] for o in order), len(first)), np.int64)
        alike = bool((left == left[0]).all())
        live = np.arange(len(first))
        for m in range(most):
            if not alike:
                live = live[left[live] > m]
            which, at = 0, position[live]
            for dc_table, ac_table, component in order:
                at, diff = _dc(buf, at, dc_table)
                predicted[component, live] += diff
                if component == 0:
                    dc[start[live] + m, which] = predicted[0, live]
                    which += 1
                at = _skip_ac(buf, at, ac_table)
            position[live] = at
        edges = start[of_frame]
        for i, f, a, b in zip(members, own, edges[:-1].tolist(), edges[1:].tolist()):
            across, down = f.mcus()
            _, h, v, q = f.parts[0]
            h, v = (1, 1) if f.alone else (h, v)
            grid = dc[a:b].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            rows, cols = (down, across) if f.alone else (-(-f.height * v // (8 * f.v_max)), -(-f.width * h // (8 * f.h_max)))
            q = f.quant[q]
            out[i] = np.clip((grid[:rows, :cols] * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return out


def _peek(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    byte = np.minimum(at >> 3, len(buf) - 3)
    three = buf[byte].astype(np.int64) << 16 | buf[byte + 1].astype(np.int64) << 8 | buf[byte + 2]
    return three >> (8 - (at & 7)) & 0xFFFF


def _dc(buf: np.ndarray, at: np.ndarray, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    bits, _, extra, value, size = _lookup(table, True)
    window = _peek(buf, at)
    step = bits[window]
    if not step.all():
        raise ValueError("no such code")
    diff = value[window]
    if (long := step > 16).any():
        e, w = extra[window[long]], _peek(buf, at[long] + size[window[long]])
        low = w >> (16 - e)
        diff[long] = np.where(low < (1 << (e - 1)), low - (1 << e) + 1, low)
    return at + step, diff


def _skip_ac(buf: np.ndarray, at: np.ndarray, table: bytes) -> np.ndarray:
    bits, symbol, _, _, _ = _lookup(table, False)
    window = _peek(buf, at)
    step, sym = bits[window], symbol[window]
    if not step.all():
        raise ValueError("no such code")
    at = at + step
    k = 1 + (sym >> 4) + 1
    live = np.flatnonzero((sym != 0) & (k < 64))
    k = k[live]
    while len(live):
        window = _peek(buf, at[live])
        step, sym = bits[window], symbol[window]
        if not step.all():
            raise ValueError("no such code")
        at[live] += step
        k = k + (sym >> 4) + 1
        more = (sym != 0) & (k < 64)
        live, k = live[more], k[more]
    return at


def average_hash(grid: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 reduction lie above its mean."""
    rows, cols = grid.shape
    r, c = np.arange(8) * rows // 8, np.arange(8) * cols // 8
    sums = np.add.reduceat(np.add.reduceat(grid, r, 0, np.int64), c, 1)
    n_r, n_c = np.maximum(np.diff(np.append(r, rows)), 1), np.maximum(np.diff(np.append(c, cols)), 1)
    small = sums / (n_r[:, None] * n_c)
    return int.from_bytes(np.packbits(small > small.mean()).tobytes(), "big")


# -- columns -------------------------------------------------------------------


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, media binary): each whole text, padded, as baseline JPEG.

    Null and empty texts are stored as ROW zero bytes; very long texts, over 524,224 bytes,
    take several images one after another. Rows are never merged or dropped;
    null ids are kept; other columns are left out; an empty table gives no rows. One
    pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", PORTION):
                data, offsets = buffers(part.column("_text"))
                media = write_payloads(*pad(data, offsets))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_many(items: list[bytes]) -> list[list[tuple[Frame, np.ndarray]] | None]:
    """Frames and thumbnails of each item; None where it is not baseline JPEG."""
    data, frames, of = b"".join(items), [], []
    shift = 0
    for i, item in enumerate(items):
        try:
            found = parse(item, i)
        except (ValueError, IndexError, KeyError, struct.error):
            found = []
        for f in found:
            f.scan = (f.scan[0] + shift, f.scan[1] + shift)
        of.append(len(found))
        frames += found
        shift += len(item)
    try:
        grids = iter(zip(frames, thumbnails(data, frames)))
    except ValueError:
        if len(items) == 1:
            return [None]
        return [read_many([x])[0] for x in items]  # one of them is broken
    return [[next(grids) for _ in range(n)] or None for n in of]


MEDIA_FIELDS = "width int, height int, frames int, thumbnail binary, thumbnail_hash string"


def read_media(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and, of each media value: width and height (of the first frame),
    frames, the DC-only luminance thumbnails (row by row, frame after frame) and
    their 64-bit hash. Null, empty and other than baseline JPEG: all null."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_media", PORTION):
                read = read_many([x or b"" for x in part.column("_media").to_pylist()])
                rows = []
                for found in read:
                    if found is None:
                        rows.append((None,) * 5)
                        continue
                    f, grids = found[0][0], [g for _, g in found]
                    same = len({g.shape[1] for g in grids}) == 1
                    rows.append((f.width, f.height, len(found), b"".join(g.tobytes() for g in grids), f"{average_hash(np.concatenate(grids) if same else grids[0]):016x}"))
                types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(list(v), t) for v, t in zip(zip(*rows), types)], [*keep, "width", "height", "frames", "thumbnail", "thumbnail_hash"])

    return df.select(*keep, F.col(media_col).alias("_media")).mapInArrow(run, f"{fields}, {MEDIA_FIELDS}")

