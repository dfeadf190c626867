import cases
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M


def water(sizes):
    """Targets by sharing again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        rest, w = total - sum(2 * sizes[s] for s in stopped), sum(weight[s] for s in names if s not in stopped)
        found = {s: 2.0 * sizes[s] if s in stopped else rest * weight[s] / w for s in names}
        above = {s for s in names if s not in stopped and found[s] > 2 * sizes[s]}
        if not above:
            return found
        stopped |= above


def check(rows):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
    want = water(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_targets_are_met_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 300)
    monkeypatch.setattr(M, "TOGETHER", 4)
    docs = [(i, "w " * (i * 37 % 90), ("hot", "b", "c", "d", "é", None)[min(5, i % 11)]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = M.mix(df.repartition(3)).collect()
    check(rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, M.mix(df.repartition(5)).collect()))
    shards = [c["shard"] for r in rows for c in r["copies"]]
    assert set(shards) <= set(range(2**M.SHARD_LEVELS)) and len(set(shards)) > 8


def test_rows_without_ids_are_told_by_their_texts(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 20)
    docs = [(None, f"a b {i}", "s") for i in range(100)] + [(None, None, "t")] * 50 + [(7, f"x {i}", "t") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = M.mix(df.repartition(3), keep=("text",)).collect()
    check(rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, M.mix(df.repartition(7), keep=("text",)).collect()))
    places = [c["place"] for r in rows for c in r["copies"]]
    assert len(set(places)) == len(places)


def test_splitting_tree_is_exact_and_draws_are_hypergeometric(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 7), ("c", 0)], "key string, units long")
    ends = {r["key"]: r["shard_ends"] for r in M.splitting_tree(quotas, 3).collect()}
    assert {k: e[-1] for k, e in ends.items()} == {"a": 100, "b": 7, "c": 0}
    per = [[b - a for a, b in zip([0, *e], e)] for e in ends.values()]
    assert all(x >= 0 for p in per for x in p) and all(12 <= sum(p[k] for p in per) <= 15 for k in range(8))
    draws = spark.range(4000).select(M._hypergeometric(F.lit(30), F.lit(80), F.lit(20), M._uniform(F.lit(1), F.col("id"))).alias("k"))
    mean, var, low, high = draws.agg(F.avg("k"), F.var_pop("k"), F.min("k"), F.max("k")).first()
    assert abs(mean - 7.5) < 0.15 and abs(var - 20 * 0.375 * 0.625 * 60 / 79) < 0.4 and 0 <= low and high <= 20
    edge = spark.range(1).select(*[M._hypergeometric(F.lit(g), F.lit(n), F.lit(d), F.lit(0.5)).alias(f"x{i}") for i, (g, n, d) in enumerate([(0, 5, 3), (5, 5, 3), (2, 5, 5), (1, 1, 0), (0, 0, 0)])]).first()
    assert tuple(edge) == (0, 3, 2, 0, 0)


def test_hard_rows(spark):
    rows = M.mix(cases.table(spark)).collect()
    assert len(rows) == len(cases.rows())
    check(rows)
    assert M.mix(cases.empty(spark)).count() == 0
    assert M.mix(spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")).select("target", "taken").distinct().collect() == [(0.0, 0)]
