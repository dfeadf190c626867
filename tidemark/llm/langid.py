"""Language identification by a convolutional network over UTF-8 bytes, trained in numpy.

The network embeds each byte, applies filters of several widths, takes the maximum of each
filter over a fixed-length window of bytes, and a softmax over the learned languages. A
document is cut into windows from its first byte to its last; the logits of its windows,
weighted by their bytes, are averaged before the last softmax.

Fitting uses a bounded sample of labelled rows (``per_language`` documents of each of the
``most`` most frequent languages, chosen by a hash over all of them, WINDOWS_PER_DOC windows
spread over each; a rarer language is never predicted);
prediction reads every byte of every document and never the label, the source or the id.

Nulls and texts without a letter give ``und`` with score 0; a table without labelled rows
gives ``und`` throughout. Ties go to the language that sorts first. Repeated rows are each
predicted; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.common import map_arrow, table, whole

UNDETERMINED = "und"
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 6
PER_LANGUAGE = 400
#: Languages that are learned, by frequency: bounds the sample as a whole.
MOST = 1000
WINDOWS_PER_DOC = 4
EPOCHS = 6
#: Windows that go through the network at once: bounds a worker's memory.
BLOCK = 512


@dataclass
class Model:
    """Weights; ``kernel`` holds all filters padded to the largest width."""

    languages: list[str]
    embedding: np.ndarray  # (257, e): the last row is the padding
    kernel: np.ndarray  # (max width * e, filters)
    bias: np.ndarray
    dense: np.ndarray  # (filters, languages)
    dense_bias: np.ndarray

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Of (n, WINDOW + max width - 1) byte numbers."""
        return self._forward(windows)[-1]

    def _forward(self, windows: np.ndarray):
        n, long = windows.shape
        e = self.embedding.shape[1]
        wide = self.kernel.shape[0] // e
        x = self.embedding[windows].reshape(n, long * e)
        steps = long - wide + 1
        views = np.lib.stride_tricks.as_strided(x, (n, steps, wide * e), (x.strides[0], e * x.itemsize, x.itemsize))
        z = views.reshape(n * steps, wide * e) @ self.kernel
        z = z.reshape(n, steps, -1)
        top = z.max(1) + self.bias
        pooled = np.maximum(top, 0)
        return views, z, top, pooled, pooled @ self.dense + self.dense_bias


def windows_of(text: bytes, window: int, wide: int) -> np.ndarray:
    """All windows of a text, the last one padded; neighbours share the filters' overhang."""
    n = max(1, -(-len(text) // window))
    held = np.full(n * window + wide - 1, 256, dtype=np.int16)
    held[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(held, window + wide - 1)[::window]


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on the cross entropy of the first window of each text, classes weighted alike."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    wide = max(WIDTHS)
    total = FILTERS * len(WIDTHS)
    mask = np.zeros((wide * EMBEDDING, total), dtype=np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
    m = Model(
        languages,
        rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(total, dtype=np.float32),
        rng.normal(0, 0.3, (total, len(languages))).astype(np.float32),
        np.zeros(len(languages), dtype=np.float32),
    )
    xs, ys = [], []
    for k, (text, label) in enumerate(zip(texts, labels, strict=True)):
        some = [text, text[: 4 + int(rng.integers(60))]] + [text.upper()] * (k % 4 == 0)  # also short texts and capitals
        xs += [windows_of(t.encode(), WINDOW, wide)[:1] for t in some]
        ys += [languages.index(label)] * len(some)
    if not xs:
        return m
    x, y = np.concatenate(xs), np.array(ys)
    share = np.bincount(y, minlength=len(languages))
    weight = (len(y) / (len(languages) * np.maximum(share, 1)))[y].astype(np.float32)
    names = ("embedding", "kernel", "bias", "dense", "dense_bias")
    first = {k: np.zeros_like(getattr(m, k)) for k in names}
    second = {k: np.zeros_like(getattr(m, k)) for k in names}
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            step += 1
            xb, yb, wb = x[part], y[part], weight[part]
            views, z, top, pooled, out = m._forward(xb)
            n, steps, f = z.shape
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), yb] -= 1
            p *= (wb / n)[:, None]
            back = (p @ m.dense.T) * (top > 0)
            at = z.argmax(1)  # (n, f)
            chosen = views[np.arange(n)[:, None], at]  # (n, f, wide * e)
            grad = {"dense": pooled.T @ p, "dense_bias": p.sum(0), "bias": back.sum(0)}
            grad["kernel"] = np.einsum("nf,nfk->kf", back, chosen) * mask
            into = (back[:, :, None] * m.kernel.T[None]).reshape(n, f, wide, EMBEDDING)
            places = xb[np.arange(n)[:, None, None], at[:, :, None] + np.arange(wide)]
            grad["embedding"] = np.zeros_like(m.embedding)
            np.add.at(grad["embedding"], places, into)
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                move = 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(m, k, (getattr(m, k) - move).astype(np.float32))
    return m


def predict(model: Model, texts: list[bytes]) -> list[tuple[str, float]]:
    """Language and probability of each text, from all of its windows."""
    wide = model.kernel.shape[0] // model.embedding.shape[1]
    sums = np.zeros((len(texts), len(model.languages)))
    sizes = np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    weights: list[np.ndarray] = []

    def flush() -> None:
        if not held:
            return
        x, who, w = np.concatenate(held), np.concatenate(owner), np.concatenate(weights)
        held.clear(), owner.clear(), weights.clear()
        for i in range(0, len(x), BLOCK):
            out = model.logits(x[i : i + BLOCK])
            np.add.at(sums, who[i : i + BLOCK], out * w[i : i + BLOCK, None])
            np.add.at(sizes, who[i : i + BLOCK], w[i : i + BLOCK])

    pending = 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), WINDOW * BLOCK * 8):
            piece = text[at : at + WINDOW * BLOCK * 8 + wide - 1]
            own = min(len(text) - at, WINDOW * BLOCK * 8)
            x = windows_of(piece, WINDOW, wide)[: max(1, -(-own // WINDOW))]
            w = np.full(len(x), float(WINDOW))
            w[-1] = max(1, own - WINDOW * (len(x) - 1))
            held.append(x)
            owner.append(np.full(len(x), k))
            weights.append(w)
            pending += len(x)
            if pending >= BLOCK * 8:
                flush()
                pending = 0
    flush()
    out = sums / np.maximum(sizes, 1)[:, None]
    p = np.exp(out - out.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return [(model.languages[b], float(p[k, b])) for k, b in enumerate(best)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, label: str = "lang", per_language: int = PER_LANGUAGE, most: int = MOST) -> Model | None:
    """Train on at most ``per_language`` documents of each of ``most`` languages, none held out.

    They are those whose hash lies under a share set from the language's count, so no
    language is gathered or sorted anywhere; equal rows count once.
    """
    usable = docs.select(F.col("doc_id"), F.col("text"), F.col(label).cast("string").alias("label"))
    usable = usable.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most).collect()
    if not counts:
        return None
    mark = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(1)), F.lit(1 << 30))
    chosen = F.lit(False)
    for row in counts:
        share = min(1.0, 1.2 * per_language / row["count"])
        chosen = chosen | ((F.col("label") == row["label"]) & (mark < int(share * (1 << 30))))
    step = F.floor(F.length("text") / WINDOWS_PER_DOC)
    spread = F.array([F.col("text").substr((step * k + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_PER_DOC)])
    sample = usable.where(chosen & F.col("text").rlike(r"\p{L}")).select("label", spread.alias("texts"), mark.alias("mark"), "doc_id")
    sample = sample.groupBy("label", "mark", "doc_id").agg(F.min("texts").alias("texts")).limit(2 * per_language * len(counts))
    rows = sorted(sample.collect(), key=lambda r: (r["label"], r["mark"], str(r["doc_id"]), r["texts"]))
    seen: dict[str, int] = {}
    kept = []
    for r in rows:
        seen[r["label"]] = seen.get(r["label"], 0) + 1
        if seen[r["label"]] <= per_language:
            kept.append(r)
    pairs = [(t, r["label"]) for r in kept for t in dict.fromkeys(r["texts"]) if t.strip()]
    return train([t for t, _ in pairs], [label for _, label in pairs]) if pairs else None


def labelled(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, lang_pred, score): every row as one struct, with what was found of its text.

    What the row holds travels with it, so that repeated and null ids need no join and no
    column can clash.
    """
    text = F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("string"))
    rows = docs.select(whole(docs), text.alias("read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(UNDETERMINED, 0.0)] * batch.num_rows
            some = [(i, t.encode()) for i, t in enumerate(batch.column(1).to_pylist()) if t is not None]
            if model is not None and some:
                for (i, _), said in zip(some, predict(model, [t for _, t in some]), strict=True):
                    found[i] = said
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["row", "lang_pred", "score"])

    return map_arrow(rows, run, StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    found = labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("row.doc_id", "lang_pred", "score")


def op10_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
