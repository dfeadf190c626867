import zlib
from collections import defaultdict

import cases
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing as P


def ids_of(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(rows, docs):
    covered, ends = defaultdict(int), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        own = docs[r["doc_id"]]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert (r["doc_tokens"], r["ids_crc32"], r["offset"]) == (len(own), zlib.crc32(piece.tobytes()), ends[r["sequence_id"]])
        covered[r["doc_id"]] += r["length"]
        ends[r["sequence_id"]] += r["length"]
    assert all(e <= P.WINDOW and (e == P.WINDOW or e & (e - 1) == 0) for e in ends.values())
    return covered


def test_every_id_is_in_one_piece(spark):
    texts = {i: t for i, t, *_ in cases.rows() if i is not None} | {100: "日本語 текст\t\n  x" * 40, 101: "<|endoftext|> 'll 've", 102: "x" * 9000}
    docs = {i: ids_of(t) for i, t in texts.items()}
    rows = P.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)).collect()
    assert check(rows, docs) == {i: len(v) for i, v in docs.items()}
    assert P.pack(cases.empty(spark)).count() == 0
    assert {r["doc_id"] for r in P.pack(cases.table(spark)).collect()} == {r[0] for r in cases.rows()}


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = P.Packer(window=16)
    for d, size in enumerate(rng.integers(1, 16, 300)):
        before = packer.counts.copy()
        options = {}
        for level in [0, *np.flatnonzero(before[:16])]:
            if level + size > 16:
                continue
            after = before.copy()
            after[level] -= level > 0
            if level + size < 16:
                after[level + size] += 1
            options[level] = int((after**2).sum())
        packer.add(d, np.arange(size, dtype="<u4"))
        assert int((packer.counts**2).sum()) == min(options.values())


def test_closing_wastes_nothing_and_bounds_open_windows():
    rng = np.random.default_rng(2)
    packer = P.Packer(window=64, max_open=10)
    sizes = rng.integers(33, 63, 500)
    for d, size in enumerate(sizes):
        packer.add(d, np.arange(size, dtype="<u4"))
        assert packer.n_open <= 10
    packer.close()
    fills = [sum(len(p[2]) for p in s) for s in packer.done]
    assert sum(fills) == sizes.sum() and sum(f != 64 for f in fills) <= 6 and all(f & (f - 1) == 0 for f in fills)
