import hashlib
import zlib

import cases
import numpy as np
import pytest

from tidemark.llm import gif as G


@pytest.mark.parametrize("top", [1, 2, 5, 256])
@pytest.mark.parametrize("n", [64, 4096, 64 * 1500])
def test_round_trip(n, top):
    payload = np.random.default_rng(n).integers(0, top, n).astype(np.uint8).tobytes()
    back, times, counts = G.read_back(G.store(payload, max_rows=400))
    assert back == payload and times == [(10 * k, 10) for k in range(len(times))] and counts.sum() == n


def test_disposal_transparency_palettes_and_interlace():
    a = np.arange(100, dtype=np.uint8).reshape(10, 10)
    b = np.full((2, 2), 7, np.uint8)
    b[0, 0] = 9
    red = bytes(v for i in range(256) for v in (i, 0, 0))
    frames = [G.Frame(a, interlaced=True), G.Frame(b, 4, 4, 5, disposal=3, transparent=9, palette=red), G.Frame(b, 0, 0, 5, disposal=2), G.Frame(b, 8, 8, 1, transparent=9)]
    shown = list(G.decode(G.encode(10, 10, frames)))
    assert (shown[0].rgb[..., 0] == a).all() and [(f.at, f.delay) for f in shown] == [(0, 10), (10, 5), (15, 5), (20, 1)]
    assert tuple(shown[1].rgb[4, 4]) == (44,) * 3 and tuple(shown[1].rgb[5, 5]) == (7, 0, 0)
    assert tuple(shown[2].rgb[5, 5]) == (55,) * 3 and tuple(shown[2].rgb[0, 0]) == (9,) * 3
    assert tuple(shown[3].rgb[0, 0]) == (0,) * 3 and tuple(shown[3].rgb[9, 9]) == (7,) * 3


def test_streams_of_other_encoders():
    # A known file: 10 x 10 pixels, code size 2, no clear code but the first.
    stream = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    out = np.frombuffer(G.lzw_decode(stream, 2, 100), np.uint8).reshape(10, 10)
    assert out[0].tolist() == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2] and out[3].tolist() == [1, 1, 1, 0, 0, 0, 0, 2, 2, 2] and out[9].tolist() == [2, 2, 2, 2, 2, 1, 1, 1, 1, 1]
    for depth in (2, 4, 7, 8):
        raw = np.random.default_rng(depth).integers(0, 1 << depth, 20000).astype(np.uint8).tobytes()
        assert G.lzw_decode(G.lzw_encode(raw, depth), depth, len(raw)) == raw
    with pytest.raises(ValueError):
        G.lzw_decode(b"\xff\xff\xff", 8, 10)


def plain_decode(stream, depth):
    """LZW by the book, code by code."""
    clear, end = 1 << depth, (1 << depth) + 1
    bits = sum(b << 8 * i for i, b in enumerate(stream))
    width, at, out, known, last = depth + 1, 0, b"", [], None
    while True:
        code = bits >> at & (1 << width) - 1
        at += width
        if code == end:
            return out
        if code == clear:
            known, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], depth + 1, None
            continue
        word = known[code] if code < len(known) else last + last[:1]
        out += word
        if last is not None and len(known) < 4096:
            known.append(last + word[:1])
            width = min(12, max(width, len(known).bit_length()))
        last = word


def test_streams_read_by_the_book():
    rng = np.random.default_rng(4)
    for depth, n, top in ((8, 1, 256), (8, 3000, 3), (8, 30000, 256), (8, 60000, 2), (3, 20000, 8)):
        raw = rng.integers(0, top, n).astype(np.uint8).tobytes()
        stream = G.lzw_encode(raw, depth)
        assert plain_decode(stream, depth) == raw == G.lzw_decode(stream, depth, n)
        assert G.lzw_decode(stream, depth, n // 2) == raw[: n // 2]


def test_streams_that_stop_clearing():
    # A full table that is used on: codes of 12 bits, and no clear code but the first.
    raw = np.random.default_rng(6).integers(0, 4, 40000).astype(np.uint8).tobytes()
    known, codes, held = {bytes([i]): i for i in range(256)}, [256], b""
    for s in raw:
        if (longer := held + bytes([s])) in known:
            held = longer
            continue
        codes.append(known[held])
        if len(known) < 4096 - 2:
            known[longer] = len(known) + 2
        held = bytes([s])
    codes += [known[held], 257]
    widths = np.append(9, G._width(8)[np.minimum(np.arange(1, len(codes)), G.FULL)])
    assert len(known) == 4094 and G.lzw_decode(G.pack_codes(np.array(codes), widths), 8, len(raw)) == raw


def test_hard_rows(spark, small):
    found = G.op6_gif_media(spark, small).collect()
    texts = {i: (t or "").encode() for i, t, *_ in cases.rows() if i is not None}
    assert len(found) == len(cases.rows())
    for r in found:
        if r["doc_id"] is None:
            continue
        own = texts[r["doc_id"]]
        payload = own + bytes(max(64, -(-len(own) // 64) * 64) - len(own))
        gif = G.store(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        counts = {}
        for b in payload:
            counts[(b >> 6) * 21] = counts.get((b >> 6) * 21, 0) + 1
        assert r["feature"] == ";".join(f"{i:02x}:{n}" for i, n in sorted(counts.items())) and sum(r["histogram"]) == len(payload)
        assert [tuple(f) for f in r["frames"]] == [(10 * k, 10) for k in range(-(-len(payload) // (64 * G.MAX_ROWS)))]
        assert (r["media_bytes"], r["media_sha256"]) == (len(gif), hashlib.sha256(gif).hexdigest())
    kept = {r["doc_id"]: bytes(r["media"]) for r in G.media(cases.table(spark)).collect()}
    assert all(G.read_back(kept[i])[0].rstrip(b"\0") == own.rstrip(b"\0") for i, own in texts.items())
    assert G.media(cases.empty(spark)).count() == 0


def test_frames_of_files(spark):
    good = G.encode(2, 2, [G.Frame(np.ones((2, 2), np.uint8)), G.Frame(np.zeros((2, 2), np.uint8))])
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"junk")), ("c", None)], "path string, content binary")
    rows = sorted(G.frames(files).collect(), key=lambda r: (r["path"], r["frame"]))
    assert [(r["path"], r["frame"], r["at"], r["error"] is None) for r in rows] == [("a", 0, 0, True), ("a", 1, 10, True), ("b", 0, None, False), ("c", 0, None, False)]
    assert sum(rows[0]["histogram"]) == 4


def test_files_that_claim_too_much(spark):
    huge = b"GIF89a" + b"\xff\xff\xff\xff\x80\0\0" + bytes(6) + b"\x2c" + bytes(4) + b"\x01\0\x01\0\0" + b"\x02\x02\x44\x01\0\x3b"
    frame = b"GIF89a" + b"\x01\0\x01\0\x80\0\0" + bytes(6) + b"\x2c" + bytes(4) + b"\xff\xff\xff\xff\0" + b"\x02\x02\x44\x01\0\x3b"
    files = spark.createDataFrame([("a", bytearray(huge)), ("b", bytearray(frame))], "path string, content binary")
    assert sorted((r["path"], r["error"]) for r in G.frames(files).collect()) == [("a", "screen too large"), ("b", "frame too large")]
