import zlib

import cases
import numpy as np
import pytest

from tidemark.llm import langid as L


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in L.op10_byte_cnn_language(spark, sf_dir).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(found) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for d, r in found.items())
    held = [d for d, r in found.items() if r["held_out"]]
    assert sum(found[d]["lang_pred"] == truth[d] for d in held) / len(held) > 0.97


@pytest.fixture(scope="module")
def model():
    return L.train(["the quick brown fox and the dog of the house"] * 40 + ["der schnelle braune Fuchs und die Mühle im Haus"] * 40, ["en"] * 40 + ["de"] * 40, epochs=4)


def test_whole_texts_in_windows(model):
    """Long texts weigh all their windows, whatever the pieces they are read in."""
    de, en = "und die Mühle im Haus der Fuchs " * 4000, "the dog of the house and the fox "
    assert L.predict(model, [(en + de).encode(), en.encode()]) [0][0] == "de"
    text = (en * 3000).encode()
    wide = model.kernel.shape[0] // L.EMBEDDING
    windows = L.windows_of(text, L.WINDOW, wide)
    weights = np.full(len(windows), float(L.WINDOW))
    weights[-1] = len(text) - L.WINDOW * (len(windows) - 1)
    out = (model.logits(windows) * weights[:, None]).sum(0) / weights.sum()
    p = np.exp(out - out.max())
    assert L.predict(model, [text])[0][1] == pytest.approx(float((p / p.sum()).max()), abs=1e-4)


def test_hard_rows(spark, model):
    found = L.identify(cases.table(spark), model).collect()
    assert len(found) == len(cases.rows())
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 7)) and by[9]["lang_pred"] == "de"
    assert L.identify(cases.empty(spark), model).count() == 0 and L.fit(cases.empty(spark)) is None
    assert {r["lang_pred"] for r in L.identify(cases.table(spark), None).collect()} == {"und"}
    whole = L.labelled(cases.table(spark), model)
    assert whole.columns == ["row", "lang_pred", "score"] and whole.select("row.*").columns == cases.table(spark).columns
