"""GeoTIFF and BigTIFF bytes to bands of tiles and back: strips or tiles; none, LZW, DEFLATE or
PackBits; predictors 1 to 3."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Field types of the format: code to struct letter and size. Fixed values.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


@dataclass
class Image:
    """What the header of an image says."""

    width: int
    height: int
    bands: int
    dtype: np.dtype
    order: str
    tags: dict[int, tuple]

    @property
    def transform(self) -> tuple[float, float, float, float]:
        """x of the left edge, cell width, y of the top edge, cell height (negative)."""
        sx, sy = self.tags.get(SCALE, (1.0, -1.0))[:2]
        i, j, _, x, y = (*self.tags.get(TIEPOINT, (0, 0, 0, 0.0, 0.0, 0.0)),)[:5]
        return x - i * sx, sx, y + j * sy, -sy

    @property
    def nodata(self) -> float | None:
        raw = self.tags.get(NODATA)
        return float(raw[0].split(b"\0")[0]) if raw else None

    @property
    def crs(self) -> str | None:
        keys = self.tags.get(GEO_KEYS, ())
        for k in range(4, len(keys), 4):
            if keys[k] in (2048, 3072) and keys[k + 1] == 0:
                return f"EPSG:{keys[k + 3]}"
        return None


def header(data: bytes) -> Image:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    magic = struct.unpack(order + "H", data[2:4])[0] if order and len(data) >= 16 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    # Places and counts have 4 bytes, or in a BigTIFF 8.
    wide, letter = (4, "I") if magic == 42 else (8, "Q")
    place = lambda at: struct.unpack(order + letter, data[at : at + wide])[0]
    at = place(4 if magic == 42 else 8)
    many, size_of_many = (struct.unpack(order + "H", data[at : at + 2])[0], 2) if magic == 42 else (place(at), 8)
    tags: dict[int, tuple] = {}
    for k in range(many):
        e = at + size_of_many + (4 + 2 * wide) * k
        tag, kind = struct.unpack(order + "HH", data[e : e + 4])
        n = place(e + 4)
        if kind not in TYPES:
            continue
        form, size = TYPES[kind]
        start = e + 4 + wide if n * size <= wide else place(e + 4 + wide)
        raw = data[start : start + n * size]
        tags[tag] = (raw,) if form == "s" else struct.unpack(order + form * n, raw)
    bands = tags.get(SAMPLES, (1,))[0]
    kind = KINDS.get((tags.get(FORMAT, (1,))[0], tags.get(BITS, (8,))[0]))
    if kind is None:
        raise ValueError("sample format")
    return Image(tags[WIDTH][0], tags[HEIGHT][0], bands, np.dtype(order + kind), order, tags)


def lzw(raw: bytes) -> bytes:
    """LZW as TIFF has it: codes from the highest bit on, one bit more a code before it is needed."""
    out: list[bytes] = []
    known: list[bytes] = []
    held, have, width, last = 0, 0, 9, b""
    for byte in raw:
        held, have = (held << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            known, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code > len(known) or code == len(known) and not last:
            raise ValueError("LZW code before its entry")
        word = known[code] if code < len(known) else last + last[:1]
        out.append(word)
        if last and len(known) < 4096:
            known.append(last + word[:1])
            width = min(12, max(9, (len(known) + 1).bit_length()))
        last = word
    return b"".join(out)


def packbits(raw: bytes) -> bytes:
    """Runs of copied and of repeated bytes."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def _unpacked(raw: bytes, image: Image, rows: int, cols: int, samples: int) -> np.ndarray:
    """A strip or tile as (rows, cols, samples)."""
    t = image.tags
    compression = t.get(COMPRESSION, (1,))[0]
    if compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif compression == 5:
        raw = lzw(raw)
    elif compression == 32773:
        raw = packbits(raw)
    elif compression != 1:
        raise ValueError(f"compression {compression}")
    predictor, size = t.get(PREDICTOR, (1,))[0], image.dtype.itemsize
    raw = raw[: rows * cols * samples * size]
    if predictor == 3:
        # Bytes of one significance stand together, differenced along the row.
        b = np.frombuffer(raw, np.uint8).reshape(rows, cols * samples * size)
        b = np.cumsum(b.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, cols * samples)
        return np.ascontiguousarray(b.transpose(0, 2, 1)).view(">" + image.dtype.str[1:]).reshape(rows, cols, samples)
    out = np.frombuffer(raw, image.dtype).reshape(rows, cols, samples)
    return np.cumsum(out, axis=1, dtype=out.dtype) if predictor == 2 else out


def blocks(data: bytes, band: int = 1, window: tuple[int, int, int, int] | None = None):
    """(first row, first column, values) of each strip or tile of a band, without its padding.

    With ``window`` (first row, first column, row and column after the last) only blocks that
    meet it are unpacked, and cut to it.
    """
    image = header(data)
    t = image.tags
    planar = t.get(PLANAR, (1,))[0] == 2
    samples = 1 if planar else image.bands
    pick = 0 if planar else band - 1
    if not 1 <= band <= image.bands:
        raise ValueError(f"band {band} of {image.bands}")
    if TILES in t:
        h, w, places, sizes = t[TILE_H][0], t[TILE_W][0], t[TILES], t[TILE_BYTES]
    else:
        h, w, places, sizes = min(t.get(ROWS_PER_STRIP, (image.height,))[0], image.height), image.width, t[STRIPS], t[STRIP_BYTES]
    across, down = -(-image.width // w), -(-image.height // h)
    first = (band - 1) * across * down if planar else 0
    for k in range(across * down):
        r, c = k // across * h, k % across * w
        rows = h if TILES in t else min(h, image.height - r)
        r0, c0, r1, c1 = window or (0, 0, image.height, image.width)
        if r >= r1 or c >= c1 or r + rows <= r0 or c + w <= c0:
            continue
        raw = data[places[first + k] : places[first + k] + sizes[first + k]]
        values = _unpacked(raw, image, rows, w, samples)[..., pick]
        top, left = max(r, r0), max(c, c0)
        yield top, left, values[top - r : min(image.height, r1) - r, left - c : min(image.width, c1) - c]


def read(data: bytes, band: int = 1) -> np.ndarray:
    image = header(data)
    out = np.zeros((image.height, image.width), image.dtype.newbyteorder("="))
    for r, c, v in blocks(data, band):
        out[r : r + v.shape[0], c : c + v.shape[1]] = v
    return out


def write(bands: np.ndarray, transform: tuple[float, float, float, float], tile: int | None = None, predictor: int = 1, nodata: float | None = None, epsg: int = 4326) -> bytes:
    """Bands (n, h, w) as a DEFLATE GeoTIFF, one plane after the other."""
    n, height, width = bands.shape
    kind = bands.dtype.newbyteorder("<")
    code = {"u": 1, "i": 2, "f": 3}[kind.kind]
    h, w = (tile, tile) if tile else (min(height, 64), width)
    parts: list[bytes] = []
    for band in bands:
        for r in range(0, height, h):
            for c in range(0, width, w):
                block = band[r : r + h, c : c + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1])))
                block = np.ascontiguousarray(block, dtype=kind)
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=block.dtype.type(0)).astype(kind)
                    raw = block.tobytes()
                elif predictor == 3:
                    b = block.astype(kind.newbyteorder(">")).view(np.uint8).reshape(block.shape[0], block.shape[1], -1)
                    b = b.transpose(0, 2, 1).reshape(block.shape[0], -1)
                    raw = np.diff(b, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
                else:
                    raw = block.tobytes()
                parts.append(zlib.compress(raw, 9))
    x, dx, y, dy = transform
    tags: dict[int, tuple[int, tuple]] = {
        WIDTH: (4, (width,)), HEIGHT: (4, (height,)), BITS: (3, (8 * kind.itemsize,) * n), COMPRESSION: (3, (8,)), PHOTOMETRIC: (3, (1,)),
        SAMPLES: (3, (n,)), PLANAR: (3, (2,)), PREDICTOR: (3, (predictor,)), FORMAT: (3, (code,) * n),
        SCALE: (12, (dx, -dy, 0.0)), TIEPOINT: (12, (0.0, 0.0, 0.0, x, y, 0.0)), GEO_KEYS: (3, (1, 1, 0, 1, 2048, 0, 1, epsg)),
    }
    if nodata is not None:
        tags[NODATA] = (2, (str(nodata).encode() + b"\0",))
    offsets, sizes = (TILES, TILE_BYTES) if tile else (STRIPS, STRIP_BYTES)
    tags |= {TILE_W: (4, (w,)), TILE_H: (4, (h,))} if tile else {ROWS_PER_STRIP: (4, (h,))}
    tags |= {sizes: (4, tuple(map(len, parts))), offsets: (4, (0,) * len(parts))}
    at = 8 + 2 + 12 * len(tags) + 4

    def packed(kind: int, values: tuple) -> bytes:
        return values[0] if kind == 2 else struct.pack("<" + TYPES[kind][0] * len(values), *values)

    extra = sum(len(b) for t in sorted(tags) if len(b := packed(*tags[t])) > 4)
    start = at + extra
    tags[offsets] = (4, tuple(start + sum(map(len, parts[:k])) for k in range(len(parts))))
    entries, more = [], b""
    for t in sorted(tags):
        kind_of, values = tags[t]
        raw = packed(kind_of, values)
        count = len(raw) if kind_of == 2 else len(values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(more))
        more += raw if len(raw) > 4 else b""
        entries.append(struct.pack("<HHI", t, kind_of, count) + place)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + b"".join(entries) + b"\0" * 4 + more + b"".join(parts)
