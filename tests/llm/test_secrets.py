import hashlib
import random
import re

import cases

from tidemark.llm import secrets as S

PATTERNS = (
    ("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


ISSUED = re.compile("|".join(f"(?:{p})" for p in S.ISSUED))


def brute(text):
    """Counts, digest of the base spans, all spans, how many were added."""
    spans, counts = [], []
    for rank, (kind, pattern, good) in enumerate(PATTERNS):
        own = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if good(m)]
        counts.append(len(own))
        spans += own
    said = lambda some: ",".join(s for *_, s in sorted(some))
    more = [(m.start(), 3, f"issued:{m.start()}:{m.end()}") for m in ISSUED.finditer(text)]
    return (*counts, hashlib.sha256(said(spans).encode()).hexdigest(), said(spans + more), len(more))


def test_query_equals_the_patterns(spark, tmp_path):
    rnd = random.Random(6)
    parts = ["token", "secret: token: ", "API_KEY", "apikey=", '"password" : "', "=", ": ", "abcdefgh1", "é😀", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "\n", "'", " ", "deadbeef" * 4, "Passwd=", "ghp_" + "aB3" * 12, "xoxb-" + "1" * 20, "-----BEGIN RSA PRIVATE KEY-----"]
    docs = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(150)]
    docs += [(200, None), (201, docs[3][1]), (201, docs[3][1]), (202, "x" * 20000 + "secret=" + "a" * 5000)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(tuple(r) for r in S.op7_blob_ledger_secrets(spark, str(tmp_path)).collect())
    assert found == sorted((d, *brute(t or "")) for d, t in docs)


def test_only_new_blobs_and_rule_versions_are_scanned(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh99"), (2, "token=abcdefgh99"), (3, "plain")], "doc_id long, text string")
    first = S.scan(df)
    assert first.new.count() == 2 * len(S.RULES)
    ledger = spark.createDataFrame(first.new.collect(), first.new.schema)
    more = df.unionByName(spark.createDataFrame([(4, "AKIA" + "Z" * 16)], "doc_id long, text string"))
    again = S.scan(more, ledger)
    assert {r["blob"] for r in again.new.collect()} == {hashlib.sha256(b"AKIA" + b"Z" * 16).hexdigest()}
    assert sorted((r["doc_id"], r["kind"]) for r in again.findings().where("size(spans) > 0").collect()) == [(1, "assign"), (2, "assign"), (4, "access")]
    newer = (S.RULES[0], S.Rule("access", 2, "AKIA[A-Z0-9]+", 0, 12), S.RULES[2])
    assert {(r["kind"], r["version"]) for r in S.scan(df, ledger, newer).new.collect()} == {("access", 2)}
    wider = S.scan(more, ledger, S.RULES + S.ADDED).new.collect()
    assert sorted((r["blob"][:4], r["kind"]) for r in wider) == sorted([(b[:4], "issued") for b in {r["blob"] for r in ledger.collect()}] + [(hashlib.sha256(b"AKIA" + b"Z" * 16).hexdigest()[:4], r.kind) for r in S.RULES + S.ADDED])


def test_thousands_of_matches(spark, tmp_path):
    text = " ".join(f"token=abcdefgh{i:05}" for i in range(20000))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r)[1:] for r in S.op7_blob_ledger_secrets(spark, str(tmp_path)).collect()] == [brute(text)]


def test_credentials_in_prose_are_found_and_prose_is_not():
    prose = "The token of the day is a secret. See https://example.org/a?b=c and commit 1a2b3c4 by the api team, key eyJust."
    assert brute(prose)[-1] == 0 and brute(prose + " ghp_" + "x" * 36)[-1] == 1


def test_hard_rows(spark, small):
    found = S.op7_blob_ledger_secrets(spark, small).collect()
    texts = {i: (t or "") for i, t, *_ in cases.rows() if i is not None}
    assert len(found) == len(cases.rows())
    assert all(tuple(r)[1:] == brute(texts[r["doc_id"]]) for r in found if r["doc_id"] is not None)
    assert S.scan(cases.empty(spark)).findings().count() == 0
