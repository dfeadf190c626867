"""Personal data: base patterns, and a character BiLSTM with CRF transitions in numpy.

Base spans of a kind are the leftmost, non-overlapping matches of its pattern that pass its
test; a match that fails is passed over. The network adds spans that the patterns miss
(spelled-out or spaced forms); it never removes a base span, and an added one overlaps none.

The network reads characters in both directions (LSTM), scores tags (outside; begin and
inside of each kind) and decodes with learned transitions. It is trained from labelled
spans: values of each kind, in plain and obfuscated forms, and look-alikes without a label,
written into contexts cut from a bounded sample of documents (``sample``, by hashed id).

Every text is looked at as a whole: its windows, which overlap by half, cover each place
within MARGIN characters of a digit of any script, an ``@`` or a spelled-out one (in brackets,
or with a spelled-out dot after it). Other text, numbers in words among it, is not decoded. Each
window is decoded by itself; then spans of one kind that overlap are joined, and where kinds
overlap the surer one stays, over the whole document.

Null texts are empty. Offsets are code points, end exclusive; spans that start together are
ordered as KINDS. Repeated rows each give a row; an empty table gives none, and training on
it uses contexts of its own; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, table

KINDS = ("email", "ip", "card", "phone")
WINDOW = 96
MARGIN = 32
HIDDEN = 12
EMBEDDING = 8
SAMPLE = 200
BATCHES = 240
BATCH = 48
#: Mean probability of its tags from which an added span counts.
SURE = 0.8
#: Windows decoded at once.
BLOCK = 512

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run is only entered at its start: what fails there fails further in.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[\d@\uff20]|[\[({] ?at ?[\])}]|(?<=\s)at(?=\s[^\n]{1,40}\sdot\s)", re.IGNORECASE)
_NOT_DIGIT = re.compile(r"[^0-9]+")
_AT = re.compile(r"[\[({ ] ?at ?[\])} ]", re.IGNORECASE)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# --- network ---------------------------------------------------------------

#: Characters are read as themselves up to 127, others as one of three classes.
ALPHABET = 132
TAGS = 1 + 2 * len(KINDS)
PAD = 131


@cache
def _plain(c: str) -> str:
    """Digits of any script and wide signs as ASCII ones."""
    n = unicodedata.decimal(c, None)
    return str(n) if n is not None else chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c


def _ascii(text: str) -> str:
    """The same number of characters."""
    return text if text.isascii() else "".join(map(_plain, text))


def _ids(text: str) -> np.ndarray:
    raw = np.frombuffer(_ascii(text).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(raw < 128, raw, np.where(raw < 0x250, 128, np.where(raw < 0x3000, 129, 130))).astype(np.int16)


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray, keep: bool = False):
        """(n, t) character numbers to (n, t, TAGS) scores, and what training needs."""
        w = self.weights
        inputs = w["embedding"][x]
        runs = []
        for d in ("f", "b"):
            seq = inputs if d == "f" else inputs[:, ::-1]
            runs.append(_lstm(seq, w[f"wx_{d}"], w[f"wh_{d}"], w[f"bias_{d}"], keep))
        hidden = np.concatenate([runs[0][0], runs[1][0][:, ::-1]], axis=2)
        out = hidden @ w["out"] + w["out_bias"]
        return (out, inputs, hidden, runs) if keep else out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x, wx, wh, bias, keep):
    n, t, _ = x.shape
    size = wh.shape[0]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    out = np.empty((n, t, size), np.float32)
    pre = x @ wx + bias
    saved = []
    for k in range(t):
        z = pre[:, k] + h @ wh
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        before, held = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, k] = h
        if keep:
            saved.append((i, f, o, g, before, tc, held))
    return out, saved


def _lstm_back(grad, x, wx, wh, saved):
    n, t, _ = x.shape
    size = wh.shape[0]
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    dz = np.empty((n, t, 4 * size), np.float32)
    dwh = np.zeros_like(wh)
    for k in range(t - 1, -1, -1):
        i, f, o, g, before, tc, held = saved[k]
        d = dh + grad[:, k]
        c = dc + d * o * (1 - tc * tc)
        z = np.concatenate([c * g * i * (1 - i), c * before * f * (1 - f), d * tc * o * (1 - o), c * i * (1 - g * g)], axis=1)
        dz[:, k] = z
        dwh += held.T @ z
        dh, dc = z @ wh.T, c * f
    flat = dz.reshape(-1, 4 * size)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


def _sums(e, moves):
    """Forward and backward log sums of a batch, and the log sum of all paths."""
    n, t, k = e.shape
    alpha = np.empty((n, t, k))
    beta = np.zeros((n, t, k))
    alpha[:, 0] = e[:, 0]
    for s in range(1, t):
        z = alpha[:, s - 1, :, None] + moves
        top = z.max(1)
        alpha[:, s] = e[:, s] + top + np.log(np.exp(z - top[:, None]).sum(1))
    for s in range(t - 2, -1, -1):
        z = moves + (e[:, s + 1] + beta[:, s + 1])[:, None]
        top = z.max(2)
        beta[:, s] = top + np.log(np.exp(z - top[:, :, None]).sum(2))
    top = alpha[:, -1].max(1)
    return alpha, beta, top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))


def _crf(e, moves, tags):
    """Loss of a batch and its gradients."""
    n, t, _ = e.shape
    alpha, beta, whole = _sums(e, moves)
    de = np.exp(alpha + beta - whole[:, None, None])
    pairs = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None] - whole[:, None, None, None]).sum((0, 1))
    rows = np.arange(n)[:, None]
    gold = e[rows, np.arange(t), tags].sum(1) + moves[tags[:, :-1], tags[:, 1:]].sum(1)
    de[rows, np.arange(t), tags] -= 1
    np.add.at(pairs, (tags[:, :-1], tags[:, 1:]), -1)
    return float((whole - gold).mean()), (de / n).astype(np.float32), (pairs / n).astype(np.float32)


def _viterbi(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    n, t, k = e.shape
    score, back = e[:, 0], np.empty((n, t, k), np.int8)
    for s in range(1, t):
        z = score[:, :, None] + moves
        back[:, s] = z.argmax(1)
        score = z.max(1) + e[:, s]
    path = np.empty((n, t), np.int8)
    path[:, -1] = score.argmax(1)
    for s in range(t - 1, 0, -1):
        path[:, s - 1] = back[np.arange(n), s, path[:, s]]
    return path


# --- training --------------------------------------------------------------


def _value(kind: int, rng: np.random.Generator) -> str:
    """A labelled value, plain or obfuscated."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda a, b: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(a, b)))
    pick = lambda *o: o[rng.integers(len(o))]
    if kind == 0:
        local = pick(word(2, 10), f"{word(2, 7)}.{word(2, 7)}", f"{word(2, 6)}{digits(2)}", f"{word(1, 4)}.{digits(2)}")
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), ("[at]", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "))
        return local + at + pick(f"{word(3, 9)}{dot}{word(2, 4)}", f"mail{digits(1)}{dot}{word(4, 8)}{dot}com")
    if kind == 1:
        return pick(".", ".", ".", " . ", "[.]").join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == 2:
        body = pick("4", "5", "37", "6011") + digits(15)
        body = body[: pick(15, 15, 14)]
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        sep = pick("", "", " ", "-", ".", "/")
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))
    head = pick("+", "+", "00", "+")
    return head + pick(f"{digits(2)} {digits(3)} {digits(6)}", f"1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(2)}-{digits(4)}-{digits(5)}", f"{digits(12)}", f"{digits(2)}/{digits(4)}/{digits(5)}")


#: Zeros of other scripts whose digits count on from them, and the wide forms.
_ZEROS = (0x660, 0x6F0, 0x966, 0xFF10)


def _spelled(kind: int, rng: np.random.Generator) -> str:
    """A value that the base patterns do not match."""
    while True:
        value = _value(kind, rng)
        if kind and rng.random() < 0.3:
            zero = _ZEROS[rng.integers(len(_ZEROS))]
            value = "".join(chr(zero + int(c)) if c.isdigit() else c for c in value)
        if not any(k == kind for _, k, _ in base_spans(value)):
            return value


def _lookalike(rng: np.random.Generator) -> str:
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexes = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40))
    options = (digits(4), digits(2), f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(3)},{digits(3)}", f"token={hexes}", f'"{hexes[:32]}"', f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"#{digits(5)}", digits(8), digits(24), "@" + "abcdef"[: rng.integers(2, 6)], "AKIA" + hexes[:16].upper(), f"{digits(4)}-{digits(2)}-{digits(2)}")
    return options[rng.integers(len(options))]


def example(contexts: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A window of text with labelled values in it: character numbers and tags."""
    context = contexts[rng.integers(len(contexts))]
    at = int(rng.integers(max(1, len(context) - WINDOW)))
    text, tags = context[at : at + int(rng.integers(0, 60))], []
    tags = [0] * len(text)
    while len(text) < WINDOW:
        if rng.random() < 0.6:
            kind = int(rng.integers(len(KINDS)))
            value = _value(kind, rng) if rng.random() < 0.6 else _spelled(kind, rng)
            marks = [1 + 2 * kind] + [2 + 2 * kind] * (len(value) - 1)
        else:
            value = _lookalike(rng)
            marks = [0] * len(value)
        tail = context[at + 60 : at + 60 + int(rng.integers(8, 60))] or "and so on "
        glue = " " if text and not text[-1].isspace() else ""
        text += glue + value + " " + tail
        tags += [0] * len(glue) + marks + [0] * (1 + len(tail))
    cut = int(rng.integers(0, len(text) - WINDOW + 1))
    marks = tags[cut : cut + WINDOW]
    return _ids(text[cut : cut + WINDOW]), np.array(marks)


def train(contexts: list[str], batches: int = BATCHES, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    contexts = [c for c in contexts if c] or ["the and of to in is for with that by on"]
    draw = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
    w = {"embedding": draw(ALPHABET, EMBEDDING, s=0.5), "out": draw(2 * HIDDEN, TAGS), "out_bias": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32)}
    for d in ("f", "b"):
        w |= {f"wx_{d}": draw(EMBEDDING, 4 * HIDDEN), f"wh_{d}": draw(HIDDEN, 4 * HIDDEN), f"bias_{d}": np.zeros(4 * HIDDEN, np.float32)}
        w[f"bias_{d}"][HIDDEN : 2 * HIDDEN] = 1
    model = Model(w)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, batches + 1):
        some = [example(contexts, rng) for _ in range(BATCH)]
        x, tags = np.array([s[0] for s in some]), np.array([s[1] for s in some])
        e, inputs, hidden, runs = model.emissions(x, keep=True)
        _, de, dm = _crf(e, w["moves"], tags)
        grad = {"moves": dm, "out": hidden.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "out_bias": de.sum((0, 1))}
        dh = de @ w["out"].T
        dx = np.zeros_like(inputs)
        for d, own in (("f", dh[:, :, :HIDDEN]), ("b", dh[:, ::-1, HIDDEN:])):
            seq = inputs if d == "f" else inputs[:, ::-1]
            into, grad[f"wx_{d}"], grad[f"wh_{d}"], grad[f"bias_{d}"] = _lstm_back(own, seq, w[f"wx_{d}"], w[f"wh_{d}"], runs[d == "b"][1])
            dx += into if d == "f" else into[:, ::-1]
        grad["embedding"] = np.zeros_like(w["embedding"])
        np.add.at(grad["embedding"], x, dx)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.03 * min(1, 2 * (1 - step / (batches + 1)))
        for k, g in grad.items():
            g = g * min(1, 5 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


# --- decoding --------------------------------------------------------------


def windows(text: str) -> list[int]:
    """Starts of the windows over every place near a trigger; neighbours overlap by half."""
    out, covered = [], -1
    half = WINDOW // 2
    for m in _TRIGGER.finditer(text):
        low, high = max(0, m.start() - MARGIN), m.end() + MARGIN
        if low > covered:
            out.append(low)
            covered = low + half
        while covered + half < high:
            out.append(covered)
            covered += half
    return out


def _plausible(kind: int, value: str) -> bool:
    """What a value of the kind holds in any spelling."""
    value = _ascii(value)
    n = len(_NOT_DIGIT.sub("", value))
    if kind == 0:
        return len(value) >= 6 and ("@" in value or _AT.search(value) is not None) and ("." in value or "dot" in value.lower())
    if kind == 1:
        parts = [p for p in _NOT_DIGIT.split(value) if p]
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= n <= 19 and luhn(_NOT_DIGIT.sub("", value))
    return 9 <= n <= 15 and value[:2] in ("00",) or value[:1] == "+" and 9 <= n <= 15


def reconciled(found: list[tuple[int, int, int, float]], base: list[Span], text: str) -> list[Span]:
    """(start, end, kind, sureness) of all windows to the added spans of the document."""
    merged: list[list] = []
    last: dict[int, list] = {}
    for start, end, kind, sure in sorted(found):
        if (p := last.get(kind)) and start < p[1]:
            p[1], p[3] = max(p[1], end), max(p[3], sure)
        else:
            last[kind] = [start, end, kind, sure]
            merged.append(last[kind])
    taken: list[tuple[int, int]] = []  # apart from each other; base spans may overlap
    for s, _, e in sorted(base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], e))
        else:
            taken.append((s, e))
    kept: list[Span] = []
    for start, end, kind, sure in sorted(merged, key=lambda s: (-s[3], s[0], s[2])):
        if sure < SURE or not _plausible(kind, text[start:end]):
            continue
        k = bisect.bisect_left(taken, (end, -1))
        if not k or taken[k - 1][1] <= start:
            bisect.insort(taken, (start, end))
            kept.append((start, kind, end))
    return kept


def added_spans(model: Model, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    places = [(k, at) for k, t in enumerate(texts) for at in windows(t)]
    found: dict[int, list] = {}
    w = model.weights
    for b in range(0, len(places), BLOCK):
        some = places[b : b + BLOCK]
        x = np.full((len(some), WINDOW), PAD, np.int16)
        for r, (k, at) in enumerate(some):
            piece = _ids(texts[k][at : at + WINDOW])
            x[r, : len(piece)] = piece
        e = model.emissions(x)
        path = _viterbi(e, w["moves"])
        marked = np.flatnonzero((path > 0).any(1))
        if not len(marked):
            continue
        alpha, beta, whole = _sums(e[marked], w["moves"])
        odds = np.exp(alpha + beta - whole[:, None, None])
        for own, r in enumerate(marked):
            k, at = some[r]
            tags, size = path[r].tolist(), min(WINDOW, len(texts[k]) - at)
            s = 0
            while s < size:
                if not tags[s]:
                    s += 1
                    continue
                kind, end = (tags[s] - 1) // 2, s + 1
                while end < size and tags[end] == 2 + 2 * kind:
                    end += 1
                sure = float(odds[own, np.arange(s, end), path[r, s:end]].mean())
                found.setdefault(k, []).append((at + s, at + end, kind, sure))
                s = end
    return [reconciled(found.get(k, []), base[k], t) for k, t in enumerate(texts)]


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def contexts_of(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """At most ``sample`` pieces of text for training, from all documents by hash.

    The count of documents sets the share of hashes to look at; the least of them come to the
    driver, equal rows as one.
    """
    told = docs.where("text is not null")
    share = min(1.0, 2.0 * sample / max(1, told.count()))
    mark = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(3))
    middle = F.col("text").substr(F.floor(F.length("text") / 3).cast("int"), F.lit(400))
    some = told.where(F.pmod(mark, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = some.select(mark.alias("mark"), middle.alias("piece")).groupBy("mark").agg(F.min("piece").alias("piece"))
    return [r["piece"] for r in rows.orderBy("mark").limit(sample).collect()]


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and how many were added."""
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(model, texts, base)
            cols: list[list] = [batch.column(0).to_pylist(), [], [], [], [], [], [], []]
            for b, m in zip(base, more, strict=True):
                count = [0] * len(KINDS)
                for _, k, _ in b:
                    count[k] += 1
                for col, v in zip(cols[1:], (*count, hashlib.sha256(said(b).encode()).hexdigest(), said(b + m), len(m)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def op3_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(contexts_of(docs)))
