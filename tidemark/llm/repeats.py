"""Suffix-array dedup of byte strings that repeat across or inside documents.

``lpf_array`` is the longest-previous-factor array of one byte string: the suffixes in
order, the longest common prefix of neighbours, and for each position its previous and next
smaller positions in suffix order, of which the better one is its longest earlier match.
``matches`` is the same for chosen starts of many strings, cut off at a length.

Over a corpus only matches of ``length`` bytes or more count, so each start of a
``length``-byte string has to know whether an earlier (LPF) or, if no copy is to stay, a
later start (the mirrored array) has the same string. That is decided in three steps:

1. The least hashed ANCHOR-byte string inside a ``length``-byte string names its bucket, so
   equal strings share a bucket. Consecutive starts with one anchor are a segment (its
   starts and the bytes they reach, less than 2 * length long). One row goes out for each
   segment, about one for 70 bytes of text, with the digest of its bytes.
2. Equal segments are counted by digest, with partial sums. Of each kind the first occurrence
   stays as its representative. The later occurrences repeat as a whole; so do all, if no
   copy is to stay. An anchor with a single kind of segment is settled by that.
3. An anchor with several kinds has its representatives' bytes cut out of the documents,
   and their LPF arrays, cut off at ``length``, tell which starts are found earlier (and,
   mirrored, later). An anchor with more than HOT kinds is not gathered: its representatives
   go through steps 1 to 3 again under longer anchors, at last under the whole strings,
   which have one kind each.

Equal segments are told by 64 bits of BLAKE2 among those of one bucket, whose name is another
64 bits of hash.

A document is a row's doc_id with its text: rows that share a doc_id and have other texts are
other documents; rows that are repeated as a whole are copies of each other, and take one
place in the order. Null texts are empty; null ids come first. Texts shorter than ``length``
keep all bytes. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, map_arrow, release, table

LENGTH = 200
ANCHOR = 64
#: Kinds of segments of one anchor up to which they are sorted in one task.
HOT = 2048
#: Bytes that are hashed, and that are sorted, at once: bounds a worker's memory.
CHUNK = 1 << 20
SORTED = 1 << 19
#: Stands for a null doc_id inside.
NO_ID = -(1 << 63)


# --- one string ------------------------------------------------------------


def suffix_array(s: bytes) -> np.ndarray:
    """Positions in suffix order, by prefix doubling."""
    n = len(s)
    rank = np.frombuffer(s, np.uint8).astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while n and step < 2 * n:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - step)] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        fresh = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        step *= 2
    return order


def lpf_array(s: bytes) -> np.ndarray:
    """LPF[i]: the longest string at i that also starts before i (overlaps count)."""
    n = len(s)
    order = suffix_array(s)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    common = [0] * n  # of a suffix and its predecessor in order
    h = 0
    for i in range(n):
        if at[i]:
            j = int(order[at[i] - 1])
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            common[int(at[i])] = h
            h = max(0, h - 1)
        else:
            h = 0
    out = np.zeros(n, np.int64)
    # A stack of positions that grow: what is popped has met its next smaller position, and
    # below it lies its previous smaller one.
    stack: list[tuple[int, int]] = []  # position, common prefix with the one below
    for k in range(n + 1):
        i, shared = (int(order[k]), common[k]) if k < n else (-1, 0)
        while stack and stack[-1][0] > i:
            position, below = stack.pop()
            out[position] = max(below, shared)
            shared = min(below, shared)
        stack.append((i, shared))
    return out


# --- hashes ----------------------------------------------------------------


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % (1 << 64)
    return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Polynomial hashes modulo 2**64 of any substrings, from prefix sums.

    Bytes enter as random words and results are mixed, so no low bits are weak alone.
    """

    def __init__(self, seed: int, size: int = CHUNK + 2 * LENGTH):
        rng = np.random.default_rng(seed)
        self.words = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        odd = int(rng.integers(1 << 61, 1 << 63)) * 2 + 1
        self.power = self._powers(odd, size)
        self.back = self._powers(_inverse(odd), size)

    @staticmethod
    def _powers(odd: int, size: int) -> np.ndarray:
        out = np.full(size, odd % (1 << 64), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.words[data] * self.power[: len(data)], out=out[1:])
        return out


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values, by doubling."""
    reach, have = 1, x
    while 2 * reach <= width:
        have = np.minimum(have[:-reach], have[reach:])
        reach *= 2
    if reach < width:
        have = np.minimum(have[: len(x) - width + 1], have[width - reach : width - reach + len(x) - width + 1])
    return have


def segments(data: np.ndarray, ends: np.ndarray, roll: Rolling, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Segments of concatenated texts: (first start, starts, anchor, digest)."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    sums = roll.sums(data)
    k = len(data) - anchor + 1
    grams = _mixed((sums[anchor:] - sums[:k]) * roll.back[:k])
    low = np.uint64((1 << 21) - 1)
    keyed = (grams & ~low) | np.arange(k, dtype=np.uint64)
    where = (_window_min(keyed, length - anchor + 1) & low).astype(np.int64)
    starts = np.arange(n)
    # A start counts if its string ends inside its own text.
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[np.minimum(text, len(ends) - 1)]
    fresh = np.ones(n, bool)
    fresh[1:] = (where[1:] != where[:-1]) | ~inside[:-1]
    first = np.flatnonzero(fresh & inside)
    if not len(first):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    stop = np.flatnonzero(inside & np.concatenate([fresh[1:] | ~inside[1:], [True]]))
    end = stop + length
    raw, digest = memoryview(data), hashlib.blake2b
    kinds = b"".join([digest(raw[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), end.tolist(), strict=True)])
    return first, stop - first + 1, grams[where[first]], np.frombuffer(kinds, np.uint64)


def _texts(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of pieces of (doc, mark, bytes) rows: whose they are, where each begins in its
    text, bytes, ends.

    A text longer than ``limit`` comes in pieces that overlap by ``LENGTH`` - 1 bytes, so
    that each start of a string lies in exactly one of them with all its bytes.
    """
    ids, begins, held, size = [], [], [], 0
    for batch in batches:
        for doc, mark, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid and len(value.as_buffer()) else np.zeros(0, np.uint8)
            for at in range(0, max(1, len(raw)), limit):
                piece = raw[at : at + limit + LENGTH - 1]
                if held and size + len(piece) > limit + LENGTH:
                    yield ids, np.array(begins), np.concatenate(held), np.cumsum([len(p) for p in held])
                    ids, begins, held, size = [], [], [], 0
                ids.append((doc, mark))
                begins.append(at)
                held.append(piece)
                size += len(piece)
    if held:
        yield ids, np.array(begins), np.concatenate(held), np.cumsum([len(p) for p in held])


_ROWS = pa.schema([("anchor", pa.int64()), ("kind", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("at", pa.int64()), ("starts", pa.int32())])


def segment_rows(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(1)
        for ids, begins, data, ends in _texts(batches):
            first, starts, key, kind = segments(data, ends, roll, length, anchor)
            own = np.searchsorted(ends, first, side="right")
            at = first - np.concatenate([[0], ends[:-1]])[own] + begins[own]
            who = np.array(ids, np.int64).reshape(-1, 2)[own]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(who[:, 0]), pa.array(who[:, 1]), pa.array(at), pa.array(starts.astype(np.int32))], schema=_ROWS)

    return map_arrow(texts.select("doc", "mark", "bytes"), run, "anchor long, kind long, doc long, mark long, at long, starts int")


# --- suffix order of the representatives -----------------------------------


def _keys(data: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` (up to 8) bytes at each place as a number, short ones ended by zeros."""
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for k in range(size):
        key = key << np.uint64(8) | padded[k : k + len(data)]
    return key


def _ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """By prefix doubling: (bytes, rank of so many first bytes at each place), to ``length``."""
    n = len(data)

    def dense(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64)
        return rank

    have = min(8, length)
    out = [(have, dense(_keys(data, have)))]
    while have < length:
        step, rank = min(have, length - have), out[-1][1]
        second = np.zeros(n, np.uint64)
        second[: n - step] = rank[step:] + np.uint64(1) if step < n else 0
        have += step
        out.append((have, dense(rank * np.uint64(n + 2) + second)))
    return out


def _common(data: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the strings at ``a`` and ``b`` have in common, up to the length of the ranks.

    Every size of ranks but the last is 8 times a power of two and is met once at most.
    """
    length, last = ranks[-1]
    out = np.where(last[a] == last[b], length, 0)
    todo = np.flatnonzero(out == 0)
    a, b, n = a[todo], b[todo], len(data)
    for size, rank in ranks[-2::-1]:
        inside = (a < n) & (b < n)
        same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        out[todo] += np.where(same, size, 0)
        a, b = a + np.where(same, size, 0), b + np.where(same, size, 0)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    going = np.ones(len(todo), bool)
    for k in range(min(8, length) - 1):
        going &= padded[a + k] == padded[b + k]
        out[todo] += going
    return np.minimum(out, length)


def _better(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place in suffix order: what it has in common with the better one of its
    previous and next smaller positions. ``common[i]`` is that of i and i - 1.

    All look at their neighbour at once; one that is larger is passed over to the one that it
    points to itself, which nothing between is smaller than.
    """
    best = np.zeros(len(order), np.int64)
    for side in (1, -1):
        p = order[::side]
        shared = common.copy() if side == 1 else np.concatenate([[0], common[:0:-1]])
        to = np.arange(len(p)) - 1
        live = np.flatnonzero(to >= 0)
        while len(live := live[(to[live] >= 0) & (p[to[live]] > p[live])]):
            over = to[live]
            less, further = np.minimum(shared[live], shared[over]), to[over]
            shared[live], to[live] = less, further
        found = np.where(to >= 0, shared, 0)
        best = np.maximum(best, found[::side])
    return best


def matches(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``starts`` (ascending): the longest string there, up to ``length`` bytes, that is at
    an earlier one (their LPF array), and that is at a later one (the mirrored array)."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks = _ranks(data, length)
    own = ranks[-1][1][starts]
    order = np.argsort(own * np.uint64(len(starts)) + np.arange(len(starts), dtype=np.uint64))
    common = np.zeros(len(starts), np.int64)
    common[1:] = _common(data, ranks, starts[order[:-1]], starts[order[1:]])
    earlier, later = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    earlier[order] = _better(order, common)
    later[order] = _better(-order, common)
    return earlier, later


def _intervals(marked: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked starts inside a row: row, first start, how many."""
    some = np.flatnonzero(marked)
    if not len(some):
        return some, some, some
    cut = np.flatnonzero((np.diff(some) != 1) | (np.diff(rows[some]) != 0)) + 1
    first = some[np.concatenate([[0], cut])]
    last = some[np.concatenate([cut - 1, [len(some) - 1]])]
    return rows[first], at[first], last - first + 1


_MARKS = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("at", pa.int64()), ("starts", pa.int32())])


def _sorted_marks(cut: DataFrame, length: int, keep: str) -> DataFrame:
    """Repeated starts of (anchor, doc, mark, at, starts, n, bytes) rows, anchors together."""

    def settle(rows: list) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        sizes = np.array([len(r[6]) for r in rows])
        counts = np.array([r[4] for r in rows])
        base = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(rows)), counts)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        earlier, later = matches(data, base[row] + offset, length)
        marked = earlier >= length if keep == "first" else (earlier >= length) | (later >= length)
        if keep != "first":
            marked &= np.array([r[5] == 1 for r in rows])[row]  # the others are marked as a whole
        which, at, n = _intervals(marked, np.array([r[3] for r in rows])[row] + offset, row)
        who = np.array([r[1:3] for r in rows], np.int64).reshape(-1, 2)[which]
        return pa.RecordBatch.from_arrays([pa.array(who[:, 0]), pa.array(who[:, 1]), pa.array(at, pa.int64()), pa.array(n, pa.int32())], schema=_MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, anchor = 0, None
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[0] != anchor and size > SORTED:
                    yield settle(held)
                    held, size = [], 0
                if not held or held[-1][:4] != r[:4]:  # else a repeated row
                    held.append(r)
                    size += len(r[6])
                anchor = r[0]
        if held:
            yield settle(held)

    dealt = cut.repartition("anchor").sortWithinPartitions("anchor", "doc", "mark", "at")
    return map_arrow(dealt.select("anchor", "doc", "mark", "at", "starts", "n", "bytes"), run, "doc long, mark long, at long, starts int")


_FINER = "anchor long, kind long, doc long, mark long, at long, starts int, n long, bytes binary"


def _finer_rows(cut: DataFrame, length: int, anchor: int) -> DataFrame:
    """The segments of (doc, mark, at, n, bytes) rows under longer anchors, with their bytes."""

    def found(held: list, roll: Rolling) -> pa.RecordBatch:
        data = np.concatenate([np.frombuffer(r[4], np.uint8) for r in held])
        ends = np.cumsum([len(r[4]) for r in held])
        first, starts, key, kind = segments(data, ends, roll, length, anchor)
        own = np.searchsorted(ends, first, side="right")
        offset = first - np.concatenate([[0], ends[:-1]])[own]
        raw = data.tobytes()
        who = np.array([r[:4] for r in held], np.int64)[own]
        columns = [
            pa.array(key.view(np.int64)),
            pa.array(kind.view(np.int64)),
            pa.array(who[:, 0]),
            pa.array(who[:, 1]),
            pa.array(who[:, 2] + offset),
            pa.array(starts.astype(np.int32)),
            pa.array(who[:, 3]),
            pa.array([raw[a : a + n + length - 1] for a, n in zip(first.tolist(), starts.tolist(), strict=True)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "kind", "doc", "mark", "at", "starts", "n", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(5)
        held, size = [], 0
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(r)
                size += len(r[4])
                if size >= SORTED:
                    yield found(held, roll)
                    held, size = [], 0
        if held:
            yield found(held, roll)

    return map_arrow(cut.select("doc", "mark", "at", "n", "bytes"), run, _FINER)


PLACE = ("doc", "mark", "at")


def _finer_marks(cut: DataFrame, length: int, keep: str, anchors: tuple[int, ...], hot: int) -> DataFrame:
    """Repeated starts of representatives whose anchor has very many kinds.

    Their strings are dealt out anew by the first of the longer ``anchors``, and what is
    still hot by the next. An anchor as long as the string has one kind, so the last one
    settles everything.
    """
    rows = checkpoint(_finer_rows(cut, length, anchors[0]))
    place = F.struct(*PLACE)
    kinds = rows.groupBy("anchor", "kind").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    kinds = checkpoint(kinds.join(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")), "anchor"))
    again = F.col("first") != F.col("last")
    wanted = kinds.where(again | (F.col("kinds") > 1))
    met = checkpoint(rows.join(wanted, ["anchor", "kind"]))
    release(rows)
    copies = met.where(again & ((place != F.col("first")) if keep == "first" else (F.col("n") == 1)))
    marks = copies.select(*PLACE, "starts")
    others = met.where((F.col("kinds") > 1) & (place == F.col("first"))).withColumn("n", F.when(again, F.lit(2).cast("long")).otherwise(F.col("n")))
    marks = marks.unionByName(_sorted_marks(others.where(F.col("kinds") <= hot), length, keep))
    if anchors[1:] and not kinds.where(F.col("kinds") > hot).isEmpty():
        marks = marks.unionByName(_finer_marks(others.where(F.col("kinds") > hot), length, keep, anchors[1:], hot))
    return marks


def _texts_of(docs: DataFrame) -> DataFrame:
    """doc_id as it is, and what names a document inside: doc (never null) and the text's hash."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(NO_ID)).alias("doc"), F.xxhash64(raw).alias("mark"), raw.alias("bytes"))


def repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, bytes (the text) and runs: (at, starts) intervals of repeated starts.

    ``keep="first"`` leaves the first occurrence in (doc_id, position) order unmarked,
    ``"none"`` marks all.
    """
    if length > LENGTH or anchor > length:
        raise ValueError(f"length is at most {LENGTH} and anchor at most length")
    texts = _texts_of(docs)
    every = checkpoint(segment_rows(texts, length, anchor))
    # Tables of their own, so that both sides of each join are plain shuffles, whose hot keys can be split.
    known = checkpoint(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    rows = checkpoint(every.join(known, "anchor"))
    release(every, known)
    counted = checkpoint(rows.groupBy("anchor", "kind").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE, "starts")).alias("first")))
    many = counted.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    copies = rows.join(counted.where("n > 1").select("anchor", "kind", "first"), ["anchor", "kind"])
    if keep == "first":
        copies = copies.where(F.struct(*PLACE) != F.struct(*[F.col(f"first.{c}") for c in PLACE]))
    marks = checkpoint(copies.select(*PLACE, "starts"))
    release(rows)
    # The bytes of the representatives that share an anchor with others.
    asked = counted.join(many, "anchor").select("anchor", "kinds", "n", "first.*")
    asked = asked.groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "kinds", "n", "at", "starts")).alias("asked"))
    own = F.transform("asked", lambda s: F.struct(*[s[c].alias(c) for c in ("anchor", "kinds", "n", "at", "starts")], F.substring("bytes", (s["at"] + 1).cast("int"), (s["starts"] + (length - 1)).cast("int")).alias("bytes")))
    cut = checkpoint(texts.drop("doc_id").join(asked, ["doc", "mark"]).select("doc", "mark", F.explode(own).alias("c")).select("doc", "mark", "c.*"))
    release(counted)
    more = _sorted_marks(cut.where(F.col("kinds") <= hot), length, keep)
    if not cut.where(F.col("kinds") > hot).isEmpty():
        more = more.unionByName(_finer_marks(cut.where(F.col("kinds") > hot), length, keep, (anchor + 3 * (length - anchor) // 4, length), hot))
    more = checkpoint(more)
    release(cut)
    found = marks.unionByName(more).groupBy("doc", "mark").agg(F.collect_set(F.struct("at", "starts")).alias("runs"))
    return texts.join(found, ["doc", "mark"], "left").select("doc_id", "bytes", "runs")


def removed(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), n_removed, n_spans, kept_sha256."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc_id, raw, runs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                kept, spans, gone, at = [], 0, 0, 0
                end = -1
                for start, n in sorted((r["at"], r["starts"]) for r in runs or ()):
                    stop = start + n - 1 + length
                    if start > end:
                        kept.append(raw[at:start])
                        spans += 1
                    if stop > end:
                        gone += stop - max(start, end)
                        end = at = stop
                kept.append(raw[at:])
                left = b"".join(kept)
                for col, v in zip(cols, (doc_id, len(raw), gone, spans, hashlib.sha256(left).hexdigest(), left), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return map_arrow(repeats(docs, length, keep), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_lpf_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).drop("kept")
