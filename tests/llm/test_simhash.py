import random

import cases
import numpy as np
import pytest
import xxhash

from tidemark.llm import components as C
from tidemark.llm import simhash as S


def plain(text):
    words, now = [], ""
    for c in (text or "") + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [now] if now else []
            now = ""
        else:
            now += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_by_the_book():
    for text in [*(r[1] for r in cases.rows()), "One TWO\x0bthree four five É", "x y z"]:
        assert S.fingerprint(text) == plain(text)


def test_classes_equal_brute_force(spark):
    rnd = random.Random(4)
    prints = [0, (1 << 64) - 1]
    for _ in range(40):
        p = rnd.getrandbits(64)
        prints.append(p)
        for _ in range(rnd.randint(0, 8)):  # chains and dense groups
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                p ^= 1 << b
            prints.append(p)
    prints = sorted(set(prints))
    want = reachable(prints, 4)
    df = spark.createDataFrame([(S._signed(p),) for p in prints], "fp long")
    got = {r["fp"]: r["root"] for r in S.classes(df).collect()}
    groups = {}
    for p, w in zip(prints, want):
        groups.setdefault(w, set()).add(got[S._signed(p)])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 1] = bits[:, 0]
    sums = (bits.T @ bits).astype(float)
    for n in (10, 10_000, 100_000_000):
        searched = S.plan(n, sums)
        assert sum(t + 1 for _, t in searched) == S.DISTANCE + 1
    groups = S.grouped_bits(500, sums, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({0, 1} <= set(g) for g in groups)


def test_hard_rows(spark, small):
    found = S.op4_simhash_pigeonhole(spark, small).collect()
    assert len(found) == len(cases.rows())
    texts = dict((i, t) for i, t, *_ in cases.rows() if i is not None)
    ids = sorted(texts)
    want = reachable([plain(texts[i]) for i in ids], 4)
    for r in found:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{plain(texts[r['doc_id']]):016x}" and r["component_id"] == ids[want[ids.index(r["doc_id"])]]
    assert S.near_duplicates(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("together", [4, 30, 50_000])
def test_components_equal_plain_search(spark, monkeypatch, together):
    monkeypatch.setattr(C, "TASK_LINKS", together)
    rnd = random.Random(together)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(60)] + [(400, 500 + i) for i in range(40)] + [(7, 7), (1, 2), (2, 1)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    least = {}
    for node in sorted(near):
        todo = [node] if node not in least else []
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = node
                todo += near[x]
    frame = spark.createDataFrame([*links, (None, 5), (6, None)], "a long, b long").repartition(5)
    found = {r["node"]: r["root"] for r in C.components(frame).collect()}
    assert {k: found.get(k, k) for k in near} == least and all(found[k] < k or found[k] == k for k in found)
    assert C.components(frame.where("false")).count() == 0
