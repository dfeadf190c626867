"""Sum-of-squares online packing of tokenised documents.

Every scan partition is a stream of its own: its documents are tokenised and packed where
they are read, so nothing is shuffled, and a lost task is rerun as a whole with the same
sequence ids (they carry the partition number).

A document longer than a window gives whole windows first; its remainder goes to the fill
level ``h`` for which the sum over levels of (open windows at that level) squared grows
least. That sum lives in one level array. At the end of a stream the open windows are
closed by cutting pieces of the emptiest ones into the gaps of the fullest; what is left
makes windows of power-of-two lengths, which need no padding.

Nulls: a null text is an empty one (only the end id); a null doc_id stays null. Repeated
rows are packed each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, table

WINDOW = 2048
END_ID = 1
#: Open windows of a stream beyond which it closes them by cutting: bounds a task's memory.
MAX_OPEN = 4096
VOCABULARY = "byte_bpe_50k"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer(vocabulary: str = VOCABULARY):
    """The public byte-level vocabulary as a function from text to an array of ids."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


class Packer:
    """The sequences of one stream. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, dtype=np.int64)  # the level array
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.done: list[list] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self.done.append([(doc_id, start, ids[start : start + self.window], total)])
            start += self.window
        if start < total:
            self._place((doc_id, start, ids[start:].copy(), total), total - start)

    def _place(self, piece, size: int) -> None:
        """Growth of the sum of squares: a new window 2N(s)+1; from h to h+s 2(N(h+s)-N(h)+1); filling one 1-2N(h)."""
        level = 0
        if self.n_open:
            held = self.counts[1 : self.window - size + 1]  # levels 1 .. window-size
            growth = 2 * (self.counts[1 + size :] - held + 1)
            growth[-1] = 1 - 2 * held[-1]
            growth[held == 0] = np.iinfo(np.int64).max
            if len(growth) and growth[best := len(growth) - 1 - int(np.argmin(growth[::-1]))] <= 2 * self.counts[size] + 1:
                level = best + 1
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            self.done.append(pieces)
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.close(final=False)

    def close(self, final: bool = True) -> None:
        """Fill the fullest open windows with pieces, cut where need be, of the emptiest."""
        bins = [(level, pieces) for level in sorted(self.open) for pieces in self.open[level]]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        low, high, rest = 0, len(bins) - 1, 0
        while low < high:
            level, taker = bins[high]
            gap = self.window - level
            while gap and low < high:
                giver = bins[low][1]
                doc_id, start, ids, total = giver.pop()
                if len(ids) > gap:
                    cut = len(ids) - gap
                    giver.append((doc_id, start, ids[:cut], total))
                    start, ids = start + cut, ids[cut:]
                taker.append((doc_id, start, ids, total))
                gap -= len(ids)
                low += not giver
            if not gap:
                self.done.append(taker)
                high -= 1
        if low == high:
            pieces = bins[low][1]
            rest = sum(len(p[2]) for p in pieces)
            if final:
                self._powers(pieces, rest)
            else:
                self.open[rest] = [pieces]
                self.counts[rest], self.n_open = 1, 1

    def _powers(self, pieces: list, rest: int) -> None:
        if rest == self.window:
            self.done.append(pieces)
            return
        pieces = pieces[::-1]
        while rest:
            gap = 1 << (rest.bit_length() - 1)
            rest -= gap
            taken = []
            while gap:
                doc_id, start, ids, total = pieces.pop()
                if len(ids) > gap:
                    pieces.append((doc_id, start + gap, ids[gap:], total))
                    ids = ids[:gap]
                taken.append((doc_id, start, ids, total))
                gap -= len(ids)
            self.done.append(taken)

    def rows(self, first: int) -> tuple[dict, int]:
        out: dict[str, list] = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        for sequence, pieces in enumerate(self.done, first):
            offset = 0
            for doc_id, start, ids, total in pieces:
                for name, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset), strict=True):
                    out[name].append(value)
                offset += len(ids)
        first += len(self.done)
        self.done = []
        return out, first


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece of a document in a sequence: see the module for its rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenizer(vocabulary), Packer(window, max_open)
        tail = np.array([end_id], dtype="<u4")
        sequence = TaskContext.get().partitionId() << 32
        types = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

        def drained(first: int) -> tuple[pa.RecordBatch, int]:
            found, first = packer.rows(first)
            return pa.RecordBatch.from_pydict(found, schema=types), first

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.concatenate([encode(text.as_py() or ""), tail]))
                if len(packer.done) >= 2000:
                    out, sequence = drained(sequence)
                    yield out
        packer.close()
        out, sequence = drained(sequence)
        yield out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
