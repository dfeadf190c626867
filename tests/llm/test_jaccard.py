import random

import cases
import corpus_pipeline as C

from tidemark.llm import jaccard as J
from tidemark.llm import simhash as S


def words(text):
    return S._WORDS.findall((text or "").translate(S._LOWER))


def grams(text):
    w = words(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def planted():
    """Texts with copies at a Jaccard of 0.72 to 0.97, a dense group of them, and a line that all share."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=4))
    common = " ".join(word() for _ in range(12))
    texts = []
    for k in range(60):
        own = [word() for _ in range(rnd.choice([20, 60, 150, 400]))]
        texts.append(" ".join(own) + " " + common)
        for _ in range(40 if k == 7 else rnd.randint(0, 3)):
            copy = list(own)
            for at in rnd.sample(range(len(own)), max(1, int(len(own) * rnd.uniform(0.004, 0.03)))):
                copy[at] = word()
            texts.append(" ".join(copy) + " " + common)
    texts += ["", None, "one two", "One  TWO", "one two three"]
    return texts


def test_near_dedup_equals_brute_force(spark):
    texts = planted()
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    missed = 0
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                missed += bin(S.fingerprint(texts[i]) ^ S.fingerprint(texts[j])).count("1") > S.DISTANCE
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert missed > 50  # pairs that SimHash at 4 bits does not link
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    kept = sorted(r["doc_id"] for r in C.near_dedup(spark, docs, "").collect())
    assert kept == sorted({find(i) for i in range(len(texts))})


def test_near_dedup_of_the_hard_rows(spark):
    kept = {r["doc_id"] for r in C.near_dedup(spark, cases.table(spark), "").collect()}
    assert 0 in kept and 2 in kept and not kept & {1, 4}


def test_texts_that_share_a_doc_id_are_judged_alone(spark):
    near, clean = "a b c d e f g h i j k l", "quite another text that nothing else is like at all"
    docs = spark.createDataFrame([(1, near), (5, near), (5, clean), (5, clean), (None, near)], "doc_id long, text string")
    got = sorted(map(tuple, C.near_dedup(spark, docs, "").collect()), key=repr)
    assert got == [(1, near), (5, clean), (None, near)]


def test_a_shingle_is_common_by_its_holders_not_by_their_share(spark, monkeypatch):
    monkeypatch.setattr(J, "SAMPLE", 1)
    line = "a line that some few share"
    texts = [f"w{i} x{i} y{i} z{i} v{i} " + (line if i % 300 == 0 else f"u{i}") for i in range(2000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    common, counts = J._common(J._texts(docs))
    own = set(J.shingles(line).tolist())
    assert own <= set(common.tolist()) and set(counts.tolist()) == {7}
