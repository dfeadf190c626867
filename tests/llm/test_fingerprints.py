import hashlib
import random

import cases
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as P


def cut(line):
    """Without patterns: up to the first stop from LEAST on, at most MOST code points."""
    while line:
        stops = [k for k in range(P.LEAST, min(P.MOST, len(line)) + 1) if line[k - 1] in ".!?,;:" and (k == len(line) or line[k] in " \t\r")]
        end = stops[0] if stops else P.MOST
        yield line[:end]
        line = line[end:]


def pieces(text):
    return {p for line in text.split("\n") for p in cut(line)}


def near(a, b):
    return len(pieces(a) & pieces(b)) / len(pieces(a) | pieces(b)) if pieces(a) | pieces(b) else 1.0


def test_query_equals_sets_of_paragraphs(spark, tmp_path):
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta,", "één", "😀", "end.", "a.b:", "!\r"]
    docs = [(i * 7 % 31, "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(0, 12)))) for i in range(30)]
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, ""), (103, "\n".join(f"line {i} of a long text" for i in range(900)))]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in P.op2_invertible_sketch(spark, str(tmp_path)).collect()}
    docs.sort()
    for (d, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        r = found[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - near(text, edited)) < 1e-12 and abs(r["near_next"] - near(text, following)) < 1e-12
    assert found[100]["fingerprint"] == found[101]["fingerprint"] and found[100]["near_next"] == 1.0


def test_peeling_recovers_the_differing_digests(spark):
    old, new = "\n".join(f"paragraph {i}" for i in range(200)), "\n".join(f"paragraph {i}" for i in range(3, 203))
    rows = P.fingerprints(spark.createDataFrame([(old, new)], "a string, b string"), "a", "b")
    r = P.compare(rows, "a", "b", "d").select("d", *[F.transform(F.array(*[F.lit(f"paragraph {i}") for i in k]), lambda p: F.xxhash64(p)).alias(n) for n, k in (("gone", range(3)), ("come", range(200, 203)))]).first()
    assert sorted(r["d"]["left"]) == sorted(r["gone"]) and sorted(r["d"]["right"]) == sorted(r["come"])


def test_a_word_in_front_leaves_later_paragraphs(spark):
    text = " ".join(f"Sentence {i} says that {i * i % 97} is the number of things that are here." for i in range(60))
    rows = P.fingerprints(spark.createDataFrame([(text, "And so. " + text)], "a string, b string"), "a", "b")
    found = P.compare(rows, "a", "b", "d").select(P.likeness(F.col("a_keys"), F.col("d"))).first()[0]
    assert found == near(text, "And so. " + text) and found > 0.8


def test_small_sketch_peels_by_itself(spark):
    rows = P.fingerprints(spark.createDataFrame([("x\ny\nz", "x\ny\nw")], "a string, b string"), "a", "b")
    d = rows.select(P.peel(P.subtract(F.col("a_cells"), F.col("b_cells")), F.lit(4).cast("long"), 0).alias("d")).first()["d"]
    assert d["ok"] and len(d["left"]) == len(d["right"]) == 1


def test_hard_rows(spark, small):
    found = P.op2_invertible_sketch(spark, small).collect()
    assert len(found) == len(cases.rows()) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert P.with_next(cases.empty(spark)).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert P.with_next(one).collect() == [(5, "abcd", "abcd")]


def test_next_of_null_and_common_ids(spark):
    texts = [(None, f"null {i}") for i in range(200)] + [(7, f"seven {i}") for i in range(400)] + [(i, f"text {i}") for i in range(100)] + [(9, "same")] * 5
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = [(r["doc_id"], r["text"], r["mark"]) for r in docs.withColumn("mark", F.xxhash64("text")).collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = sorted(((a[0], a[1], b[1]) for a, b in zip(rows, rows[1:] + rows[:1])), key=repr)
    assert sorted(map(tuple, P.with_next(docs).collect()), key=repr) == want
