"""GIF media columns: LZW streams, palettes, disposal, transparency and timed frames.

``decode`` reads any GIF87a/89a: global and local palettes, interlaced rows, graphic control
extensions (delay, transparent index, disposal to background or to the previous frame) and
LZW streams with early, late or no clear codes. It yields composited frames. ``encode``
writes one frame or more of 8-bit palette samples.

``media`` stores the bytes of each text as the samples of a GIF 64 pixels wide under a grey
palette, one frame for every MAX_ROWS rows, and reads them back from the composited frames.

Null texts are empty; the payload of an empty text is 64 zero bytes. Repeated rows each
give a row; equal texts give equal values; an empty table gives no rows; other columns are
not read. A broken stream, or one that claims over MAX_PIXELS, raises ValueError in
``decode``; ``frames`` returns an error column instead of failing the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, table

WIDTH = 64
MAX_ROWS = 16384
DELAY = 10  # hundredths of a second
BINS = 4  # of each colour channel
GREY = bytes(v for i in range(256) for v in (i, i, i))
FULL = 4096  # codes of 12 bits
#: Pixels of a screen or of a frame; files that claim more are refused.
MAX_PIXELS = 1 << 25


def pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes to bits, each from its lowest bit on."""
    ends = np.cumsum(widths)
    at = ends - widths
    held = codes.astype(np.int64) << (at & 7)  # at most 19 bits: three bytes
    size = (int(ends[-1]) + 7) // 8
    out = np.zeros(size + 3)
    for k in range(3):
        # No two codes share a bit, so sums are unions.
        out += np.bincount((at >> 3) + k, weights=held >> 8 * k & 255, minlength=size + 3)
    return out[:size].astype(np.uint8).tobytes()


def lzw_encode(samples: bytes, depth: int = 8) -> bytes:
    """A stream that starts with a clear code and clears again when the table is full."""
    clear, end = 1 << depth, (1 << depth) + 1
    codes, resets = [clear], [0]
    put = codes.append
    after: list[dict[int, int]] = [{} for _ in range(end + 1)]  # of each code: the code that one more sample makes
    add = after.append
    held = samples[0] if samples else -1
    here = after[held]
    for s in memoryview(samples)[1:]:
        found = here.get(s)
        if found is not None:
            held = found
            here = after[found]
            continue
        put(held)
        held = s
        free = len(after)
        if free < FULL:
            here[s] = free
            add({})
        else:
            resets.append(len(codes))
            put(clear)
            after = [{} for _ in range(end + 1)]
            add = after.append
        here = after[s]
    if held >= 0:
        put(held)
    put(end)
    # The k-th code after a clear code may refer to clear + 1 + k entries: its width follows.
    number = np.arange(len(codes))
    since = number - np.repeat(resets, np.diff([*resets, len(codes)]))
    widths = _width(depth)[since]
    widths[resets[1:]] = 12
    widths[0] = depth + 1
    return pack_codes(np.array(codes), widths)


@cache
def _width(depth: int) -> np.ndarray:
    """Bits of the code that stands so many codes after a clear code."""
    top = (1 << depth) + np.maximum(np.arange(FULL + 1), 1)  # largest code that a reader may know here
    return np.minimum(12, np.floor(np.log2(top)).astype(np.int64) + 1)


def _lengths(codes: np.ndarray, clear: int) -> tuple[np.ndarray, np.ndarray]:
    """Of codes since a clear code: the one that each repeats and extends (itself, if it is a
    sample), and its samples."""
    back = codes - (clear + 2)
    up = np.where(back < 0, np.arange(len(codes)), back)
    steps, at = (back >= 0).astype(np.int64), up
    while True:
        more = steps[at]
        if not more.any():
            return up, steps + 1
        steps, at = steps + more, at[at]


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes since a clear code.

    The entry that the k-th code makes is what that code gave and the sample after it: a code
    copies from earlier output. Each sample points to where it is copied from, and pointers
    are followed in doubling steps to the samples that stand for themselves.
    """
    up, length = _lengths(codes, clear)
    ends = np.cumsum(length)
    start = ends - length
    out = np.zeros(int(ends[-1]), np.uint8)
    own = codes < clear
    out[start[own]] = codes[own]
    source = np.arange(len(out)) - np.repeat(start - start[up], length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return out[source]
        source = further


def lzw_decode(stream: bytes, depth: int, size: int) -> bytes:
    """The first ``size`` samples of a stream (fewer if it ends).

    The width of a code follows from how many stand since the last clear code, so a run of
    codes is cut out of the bits at once.
    """
    if not 1 <= depth <= 8:
        raise ValueError("LZW code size")
    clear, end = 1 << depth, (1 << depth) + 1
    total = 8 * len(stream)
    held = np.frombuffer(stream + b"\0\0", dtype=np.uint8).astype(np.uint32)
    three = held[:-2] | held[1:-1] << 8 | held[2:] << 16
    schedule = _width(depth)[1:]
    place = np.cumsum(schedule) - schedule
    grown = FULL - end  # codes since a clear code that can add an entry, the first of them adding none
    out: list[np.ndarray] = []
    some: list[np.ndarray] = []  # runs since the last clear code
    got, at, since, table = 0, 0, 0, np.zeros(0, np.int64)
    while got < size:
        # A run ends where the table is full; from there on all codes have 12 bits.
        w, p = (schedule[since:grown], place[since:grown] - place[since]) if since < grown else (np.full(FULL, 12), np.arange(FULL) * 12)
        n = int(np.searchsorted(p + w, total - at, side="right"))
        if not n:
            break
        w, p = w[:n], p[:n] + at
        codes = ((three[p >> 3] >> (p & 7).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)).astype(np.int64)
        marks = np.flatnonzero((codes == clear) | (codes == end))
        run = codes[: marks[0]] if len(marks) else codes
        if (run > clear + 1 + np.minimum(since + np.arange(len(run)), FULL - 2 - clear)).any():
            raise ValueError("LZW code before its entry")
        if len(run):
            some.append(run)
            if since < grown:
                table = _lengths(run, clear)[1] if not since else _lengths(np.concatenate(some), clear)[1]
                got += int(table[since:].sum())
            else:
                got += int(np.where(run < clear, 1, table[np.maximum(run - clear - 2, 0)] + 1).sum())
        since += len(run)
        if len(marks):
            at = int(p[marks[0]] + w[marks[0]])
            if some:
                out.append(_expand(np.concatenate(some), clear))
            some, since = [], 0
            if codes[marks[0]] == end:
                break
        else:
            at = int(p[-1] + w[-1])
    if some:
        out.append(_expand(np.concatenate(some), clear))
    return (np.concatenate(out)[:size] if out else np.zeros(0, np.uint8)).tobytes()


def _blocks(data: bytes) -> bytes:
    parts = [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(parts) + b"\x00"


@dataclass
class Frame:
    """A frame to write: 8-bit samples, its place, and its graphic control."""

    samples: np.ndarray  # (h, w) uint8
    left: int = 0
    top: int = 0
    delay: int = DELAY
    disposal: int = 1
    transparent: int | None = None
    palette: bytes | None = None
    interlaced: bool = False


def _rows(height: int) -> np.ndarray:
    """Row order of an interlaced frame."""
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def encode(width: int, height: int, frames: list[Frame], palette: bytes = GREY) -> bytes:
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", flags, f.delay, f.transparent or 0, 0))
        h, w = f.samples.shape
        local = 0x87 if f.palette else 0
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, local | 0x40 * f.interlaced) + (f.palette or b""))
        rows = f.samples[_rows(h)] if f.interlaced else f.samples
        out.append(b"\x08" + _blocks(lzw_encode(rows.tobytes())))
    return b"".join(out) + b"\x3b"


@dataclass
class Shown:
    """A composited frame: colours of the whole screen and when it is shown."""

    rgb: np.ndarray  # (height, width, 3) uint8
    at: int  # hundredths of a second
    delay: int
    box: tuple[int, int, int, int]  # left, top, width, height of what was drawn


def decode(data: bytes) -> Iterator[Shown]:
    """Frames in order, each after the rules of the one before have been applied."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, back, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > MAX_PIXELS:
        raise ValueError("screen too large")
    at = 13
    shared = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8).reshape(-1, 3)
        at += 3 * n
    ground = shared[back] if shared is not None and back < len(shared) else np.zeros(3, np.uint8)
    screen = np.empty((height, width, 3), np.uint8)
    screen[:] = ground
    clock, delay, disposal, clear = 0, 0, 0, None

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            if at >= len(data):
                raise ValueError("cut short")
            n = data[at]
            if not n:
                return b"".join(parts), at + 1
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            body, after = sub_blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear = body[3] if body[0] & 1 else None
            at = after
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            if w * h > MAX_PIXELS:
                raise ValueError("frame too large")
            at += 10
            colours = shared
            if flags & 0x80:
                n = 2 << (flags & 7)
                colours = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8).reshape(-1, 3)
                at += 3 * n
            if colours is None:
                raise ValueError("no palette")
            depth = data[at]
            stream, at = sub_blocks(at + 1)
            samples = np.frombuffer(lzw_decode(stream, depth, w * h).ljust(w * h, b"\x00"), dtype=np.uint8).reshape(h, w)
            if flags & 0x40:
                rows = np.empty_like(samples)
                rows[_rows(h)] = samples
                samples = rows
            before = screen.copy() if disposal == 3 else None
            # What lies outside of the screen is not drawn.
            samples = samples[: max(0, height - top), : max(0, width - left)]
            target = screen[top : top + samples.shape[0], left : left + samples.shape[1]]
            drawn = colours.take(samples, axis=0, mode="clip")
            if clear is None:
                target[:] = drawn
            else:
                np.copyto(target, drawn, where=(samples != clear)[..., None])
            yield Shown(screen.copy(), clock, delay, (left, top, samples.shape[1], samples.shape[0]))
            clock += delay
            if disposal == 2:
                target[:] = ground
            elif disposal == 3:
                screen = before
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("unknown block")


def histogram(rgb: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Pixels by colour: ``bins`` levels of each channel."""
    level = rgb.astype(np.uint16) * np.uint16(bins) >> 8
    return np.bincount(((level[..., 0] * np.uint16(bins) + level[..., 1]) * np.uint16(bins) + level[..., 2]).reshape(-1), minlength=bins**3)


def store(payload: bytes, width: int = WIDTH, max_rows: int = MAX_ROWS) -> bytes:
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    parts = [samples[i : i + max_rows] for i in range(0, len(samples), max_rows)]
    return encode(width, min(len(samples), max_rows), [Frame(p) for p in parts])


def read_back(data: bytes) -> tuple[bytes, list[tuple[int, int]], np.ndarray]:
    """Payload (the first channel of each drawn box), (time, delay) of frames, histogram."""
    parts, times, counts = [], [], 0
    for shown in decode(data):
        left, top, w, h = shown.box
        drawn = shown.rgb[top : top + h, left : left + w]
        parts.append(drawn[..., 0].tobytes())
        times.append((shown.at, shown.delay))
        counts = counts + histogram(drawn)
    return b"".join(parts), times, counts


def payload_of(text: bytes, unit: int = 64) -> bytes:
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\x00")


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the GIF), what was read back of it: payload_bytes, payload_sha256,
    tail_crc32, the timed frames, and the histogram of all drawn colours."""
    names = ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "frames", "histogram"]
    frame = pa.struct([("at", pa.int64()), ("delay", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.list_(frame), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = (text.as_py() or "").encode()
                gif = store(payload_of(own))
                back, times, counts = read_back(gif)
                rows.append((doc_id, len(own), gif, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), [{"at": a, "delay": d} for a, d in times], counts.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, frames array<struct<at:long,delay:long>>, histogram array<long>"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def frames(files: DataFrame, content: str = "content") -> DataFrame:
    """Timed frames of a table of GIFs (columns ``path`` and ``content``): one row for each
    frame with its colours as bytes and the histogram as a column, or one with an error."""
    names = ["path", "frame", "at", "delay", "width", "height", "rgb", "histogram", "error"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k = 0
                try:
                    for k, f in enumerate(decode(data.as_py() or b"")):
                        h, w, _ = f.rgb.shape
                        row = (path, k, f.at, f.delay, w, h, f.rgb.tobytes(), histogram(f.rgb).tolist(), None)
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)
                except (ValueError, IndexError, struct.error) as e:
                    row = (path, k, None, None, None, None, None, None, str(e))
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    return map_arrow(files.select(F.col("path").cast("string").alias("path"), F.col(content).cast("binary").alias("content")), run, "path string, frame int, at long, delay long, width int, height int, rgb binary, histogram array<long>, error string")


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media(table(spark, sf_dir, "documents"))
    bins = F.transform("histogram", lambda n, i: F.struct(i.alias("i"), n.alias("n")))
    told = F.transform(F.filter(bins, lambda b: b["n"] > 0), lambda b: F.concat(F.lower(F.lpad(F.hex(b["i"]), 2, "0")), F.lit(":"), b["n"].cast("string")))
    return found.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(told, ";").alias("feature"),
        "frames",
        "histogram",
    )
