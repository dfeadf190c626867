import hashlib
import random
import re

import cases
import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(s):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(s)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(s) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(s) if 12 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(s) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def contexts():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    return [t[len(t) // 3 :][:400] for t in texts]


@pytest.fixture(scope="module")
def model(contexts):
    return P.train(contexts[:120])


def test_base_equals_the_patterns():
    rnd = random.Random(1)
    for _ in range(6000):
        s = "".join(rnd.choice("ab1234567890.@+- ()_%é") for _ in range(rnd.randint(0, 60)))
        assert P.base_spans(s) == brute(s), s
    assert P.base_spans("4111 1111 1111 1111") == [(0, 2, 19)]


def test_held_out_tags(model, contexts):
    rng = np.random.default_rng(9)
    some = [P.example(contexts[120:], rng) for _ in range(80)]
    x, tags = np.array([s[0] for s in some]), np.array([s[1] for s in some])
    path = P._viterbi(model.emissions(x), model.weights["moves"])
    assert (path == tags).mean() > 0.95


def test_windows_overlap_and_spans_are_joined():
    long = "9" * 300
    starts = P.windows(long)
    assert starts[0] == 0 and all(b - a == P.WINDOW // 2 for a, b in zip(starts, starts[1:])) and starts[-1] + P.WINDOW >= 300
    text = "call 0049 30 123456789 now"
    assert P.reconciled([(5, 15, 3, 0.9), (10, 22, 3, 0.95), (7, 9, 1, 0.85)], [], text) == [(5, 3, 22)]
    assert P.reconciled([(5, 22, 3, 0.99)], [(5, 2, 9)], text) == []


def test_no_added_span_lies_in_a_base_one():
    inside = "a" + ".1.2.3" * 16 + "@example.org"
    base = [(0, 0, 107), *[(1 + 6 * k, 1, 6 + 6 * k) for k in range(12)]]
    assert P.reconciled([(96, 103, 1, 0.99)], base, inside.ljust(107)) == []


def test_added_spans_of_labelled_documents(model, contexts):
    """Documents with spelled-out values, each labelled, and as many without any."""
    rng = np.random.default_rng(21)
    texts, labels = [], []
    for k in range(240):
        context = contexts[120 + k % (len(contexts) - 120)]
        value = P._spelled(k % 4, rng)
        cut = context.find(" ", len(context) // 2) + 1
        texts += [context[:cut] + value + " " + context[cut:], context]
        labels += [(cut, k % 4, cut + len(value)), None]
    base = [P.base_spans(t) for t in texts]
    added = P.added_spans(model, texts, base)
    hit = sum(any(s < want[2] and e > want[0] and k == want[1] for s, k, e in got) for got, want in zip(added, labels, strict=True) if want)
    good = sum(bool(want) and s < want[2] and e > want[0] for got, want in zip(added, labels, strict=True) for s, k, e in got)
    print("recall", hit / 240, "precision", good / max(1, sum(map(len, added))))
    assert hit / 240 >= 0.6 and good / sum(map(len, added)) >= 0.9


def test_triggers_of_other_scripts():
    assert P.windows("plain words only") == [] and P.windows("call \u0661\u0662\u0663") and P.windows("jane at example dot com") and P.windows("jane {at} example.com")
    assert P._ascii("\uff11\u0662x\uff20") == "12x@" and len(P._ids("\uff11\U0001f600")) == 2


def test_hard_rows(spark, model):
    found = P.find(cases.table(spark), model).collect()
    assert len(found) == len(cases.rows())
    texts = {i: (t or "") for i, t, *_ in cases.rows() if i is not None}
    for r in found:
        if r["doc_id"] is None:
            continue
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(P.said(base).encode()).hexdigest()
        assert set(filter(None, P.said(base).split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
    assert P.find(cases.empty(spark), model).count() == 0 and P.contexts_of(cases.empty(spark)) == []
