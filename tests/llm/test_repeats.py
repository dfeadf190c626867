import hashlib
import random
from collections import defaultdict

import cases
import numpy as np
import pytest

from tidemark.llm import repeats as R


def test_lpf_array_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(100):
        s = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 30)))
        for i, found in enumerate(R.lpf_array(s)):
            assert found == max([0] + [next((k for k in range(len(s) - i + 1) if i + k >= len(s) or s[i + k] != s[j + k]), 0) for j in range(i)])


def test_matches_of_chosen_starts_equal_brute_force():
    rnd = random.Random(4)
    for k in range(60):
        length = rnd.choice([1, 5, 8, 20, 64, 200])
        data = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(length, 400))) if k % 3 else b"ab" * 150
        starts = np.array(sorted(rnd.sample(range(len(data) - length + 1), rnd.randint(1, min(60, len(data) - length + 1)))))
        earlier, later = R.matches(np.frombuffer(data, np.uint8), starts, length)
        shared = lambda i, j: next((n for n in range(length) if data[i + n] != data[j + n]), length)  # noqa: E731, B023
        assert earlier.tolist() == [max([0] + [shared(i, j) for j in starts if j < i]) for i in starts]
        assert later.tolist() == [max([0] + [shared(i, j) for j in starts if j > i]) for i in starts]
        if length == 200:
            whole = R.lpf_array(data)
            every = R.matches(np.frombuffer(data, np.uint8), np.arange(len(data) - length + 1), length)[0]
            assert every.tolist() == np.minimum(whole[: len(every)], length).tolist()


def brute(docs, length, keep):
    at = defaultdict(list)
    for d, t in sorted(docs, key=lambda x: x[0]):
        for i in range(len(t) - length + 1):
            at[t[i : i + length]].append((d, i))
    out = {}
    for d, t in docs:
        gone = [False] * (len(t) + 1)
        for i in range(len(t) - length + 1):
            own = at[t[i : i + length]]
            if len(own) > 1 and (keep == "none" or own[0] != (d, i)):
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


def documents():
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    texts = ["a" * 900, "ab" * 450 + "z", "", None, base, base[:300] + "X" + base[301:], "q" + base[100:320] + "w", base[100:299], "é" * 150, "xyz" * 700, "é" * 200, "plain"]
    head = "a common header of sixty-four bytes or more, so that it can be an anchor, "
    texts += [head + "".join(rnd.choice("abcdef ") for _ in range(250)) for _ in range(20)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("keep", "hot"), [("none", 2048), ("first", 2048), ("none", 3), ("first", 3)])
def test_equals_brute_force(spark, monkeypatch, keep, hot):
    monkeypatch.setattr(R, "repeats", lambda d, n, k, f=R.repeats: f(d, n, k, hot=hot))
    docs = documents()
    found = R.removed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 200, keep).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute([(d, (t or "").encode()) for d, t in docs], 200, keep)


def test_long_texts_are_cut_without_a_gap(spark, monkeypatch):
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefghij") for _ in range(5000))
    docs = [(1, text), (2, text[1500:2300] + "Q")]
    monkeypatch.setattr(R._texts, "__defaults__", (700,))
    found = R.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in found} == {1: (800, 1), 2: (800, 1)}


def test_rows_that_share_a_doc_id(spark):
    rnd = random.Random(2)
    a, b, c = ("".join(rnd.choices("abcdefgh ", k=600)) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (None, c), (None, c[:300] + "#")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in R.removed(docs).collect()))
    assert got == [(0, 301, 300), (0, 600, 300), (1, 600, 0), (1, 600, 600), (2, 600, 600)]
    first = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in R.removed(docs, keep="first").collect()))
    assert sum(n for *_, n in first) == 900 and (1, 600, 0) in first


def test_hard_rows(spark, small):
    found = R.op1_lpf_repeats(spark, small).collect()
    assert len(found) == len(cases.rows())
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    assert all(r["n_removed"] == r["n_bytes"] for r in by[0] + by[1]) and by[3][0]["n_bytes"] == 0 and len(by[None]) == 2
    assert R.removed(cases.empty(spark)).count() == 0
