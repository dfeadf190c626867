import cases
import corpus_pipeline as C
import test_secrets
import test_simhash

from tidemark.llm import mixing


def test_stages_keep_columns_and_take_effect(spark):
    docs = cases.table(spark)
    texts = {r[0]: r[1] for r in cases.rows()}
    by = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "secret_scan", "mix", "packing"]

    spoken = by["language_id"](spark, docs, "").cache()
    assert spoken.columns == docs.columns
    kept = {r["doc_id"] for r in spoken.collect()}
    assert not kept & {3, 4, 7} and {0, 1, 2, 8, 9} <= kept

    single = by["near_dedup"](spark, docs, "")
    ids = sorted(i for i in texts if i is not None)
    roots = test_simhash.reachable([test_simhash.plain(texts[i]) for i in ids], 4)
    want = sorted(i for k, i in enumerate(ids) if roots[k] == k)
    rows = single.collect()
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == want
    assert sum(r["doc_id"] is None for r in rows) == 2

    clean = by["secret_scan"](spark, docs, "")
    assert clean.columns == docs.columns
    assert sorted(map(repr, clean.collect())) == sorted(repr(r) for r in docs.collect() if not test_secrets.brute(r["text"] or "")[-2])

    mixed = by["mix"](spark, docs, "")
    assert mixed.columns == docs.columns
    used = {}
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"]) and (texts[r["doc_id"]] or "no id at all").startswith(r["text"]) or r["doc_id"] is None
        used[r["source"]] = used.get(r["source"], 0) + len(r["text"].split())
    for r in mixing.mix(docs).select("source", "target").distinct().collect():
        assert abs(used.get(r["source"], 0) - r["target"]) <= 1

    extra = cases.EXTRA.replace(",", "").split()[::2]
    for stage in (spoken, single, clean, mixed):
        assert all(tuple(r[c] for c in extra) == cases.MORE for r in stage.collect() if r["source"] or r["text"])

    empty = cases.empty(spark)
    for name, stage in C.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_run_chains_the_stages(spark, small):
    rows = C.run(spark, small).collect()
    assert rows and not {r["doc_id"] for r in rows} & {1, 3, 4, 7, 10, 11}


def test_mix_leaves_by_shard_and_place(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * (i % 7 + 1), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    want = [r["doc_id"] for r in mixing.mix(docs).selectExpr("doc_id", "explode(copies) as use").orderBy("use.shard", "use.place").collect()]
    assert [r["doc_id"] for r in C.mix(spark, docs, "").collect()] == want
