"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; a bit is set where more than half of the document's word shingles
have it set in their XXH64. Two fingerprints link at ``distance`` differing bits or fewer.

Search. Distinct fingerprints stand for all documents that share one. Bits that vary
together over all fingerprints are put in the same partition. If partition i gets the
threshold t_i (-1: not searched) and the t_i + 1 add up to distance + 1, every pair within
``distance`` agrees in some partition to t_i bits or fewer. The thresholds, and the number
of partitions, are those with the least probes and candidates, by dynamic programming on
candidate counts estimated from the bit frequencies of all fingerprints. Each fingerprint
then probes the values within t_i of its own; a candidate is verified inside the join.

Dense groups. Before the search, every fingerprint is held against one that shares a
partition value, the same for all (a star: as many rows as fingerprints), and the components of
those links are contracted. The search gives only links between different components. Under
a partition value that component with most holders is not held against itself: its probes
meet the other holders only. So near copies in thousands do not give all their pairs, and
no link between components is lost.

Texts without a word, null or empty, have fingerprint zero and link like any other. Ties in
a bit (exactly half) give 0. Repeated rows share a class; a null doc_id is kept and never is
a class id unless alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, map_arrow, release, table
from tidemark.llm.components import TASK_LINKS, components

BITS = 64
SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Hashes that are folded at once.
CHUNK = 1 << 16

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of all shingles in order, repeats included."""
    words = _WORDS.findall((text or "").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    joined = " ".join(words).encode()
    ends = np.cumsum(np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fold(found: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(found), CHUNK):
        h = found[at : at + CHUNK].astype("<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return fold(hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


# --- the plan of the search ------------------------------------------------


def moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and the 64 x 64 counts of bits set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, sums = n + len(bits), sums + bits.T @ bits
        yield pa.RecordBatch.from_pydict({"i": list(range(BITS)), "n": [n] * BITS, "row": sums.tolist()}, schema=pa.schema([("i", pa.int32()), ("n", pa.int64()), ("row", pa.list_(pa.float64()))]))

    parts = map_arrow(fps.select("fp"), run, "i int, n long, row array<double>")
    total = parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(BITS)]).collect()
    sums = np.zeros((BITS, BITS))
    for r in total:
        sums[r["i"]] = [r[f"c{j}"] for j in range(BITS)]
    return (int(total[0]["n"]) if total else 0), sums


def grouped_bits(n: int, sums: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal size; each grows from a free bit by its closest relatives."""
    share = np.diag(sums) / max(n, 1)
    cov = sums / max(n, 1) - np.outer(share, share)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    near = np.abs(cov / np.outer(spread, spread))
    free = list(range(BITS))
    out = []
    for k in range(parts):
        size = BITS * (k + 1) // parts - BITS * k // parts
        own = [max(free, key=lambda b: (near[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (near[b, own].mean(), -b)))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def allocate(n: int, sums: np.ndarray, groups: list[list[int]], distance: int = DISTANCE) -> tuple[list[int], float]:
    """Thresholds by dynamic programming, and their cost in rows for one fingerprint."""
    share = np.diag(sums) / max(n, 1)
    costs = []
    for own in groups:
        odds = np.zeros(len(own) + 1)  # of a random pair to differ in so many bits of the partition
        odds[0] = 1
        for b in own:
            differ = 2 * share[b] * (1 - share[b])
            odds[1:] = odds[1:] * (1 - differ) + odds[:-1] * differ
            odds[0] *= 1 - differ
        cost = [0.0]  # threshold -1
        for t in range(distance + 1):
            probes = sum(comb(len(own), j) for j in range(t + 1))
            cost.append(1 + probes + 0.05 * n * odds[: t + 1].sum())
        costs.append(cost)
    best = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best.items():
            for take in range(distance + 2 - used):
                option = (so_far + cost[take], [*chosen, take - 1])
                if used + take not in nxt or option < nxt[used + take]:
                    nxt[used + take] = option
        best = nxt
    total, thresholds = best[distance + 1]
    return thresholds, total


def plan(n: int, sums: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The cheapest partitioning, as (bits, threshold) of each searched partition."""
    options = []
    for parts in range(2, distance + 2):
        groups = grouped_bits(n, sums, parts)
        thresholds, cost = allocate(n, sums, groups, distance)
        options.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(options, key=lambda o: o[:2])
    return [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]


# --- search ----------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    return _signed(sum(1 << b for b in bits))


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _held(labelled: DataFrame, searched: list[tuple[list[int], int]]) -> DataFrame:
    """Each fingerprint once under each of its partition values."""
    values = F.array([F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("value")) for i, (bits, _) in enumerate(searched)])
    return labelled.withColumn("key", F.explode(values)).select("key.part", "key.value", *labelled.columns)


def stars(labelled: DataFrame, searched: list[tuple[list[int], int]], distance: int, turn: int) -> DataFrame:
    """Links of each fingerprint to one other that shares a partition value: the one that
    comes first by a hash that changes from turn to turn."""
    held = _held(labelled, searched)
    first = held.groupBy("part", "value").agg(F.min_by("fp", F.xxhash64("fp", F.lit(turn))).alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    return held.join(first, ["part", "value"]).where((F.col("fp") != F.col("centre")) & (_apart(F.col("fp"), F.col("centre")) <= distance)).select(F.col("fp").alias("a"), F.col("centre").alias("b"))


def probe_links(labelled: DataFrame, searched: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """All links between fingerprints of different components: (root of one, root of other)."""
    held = _held(labelled, searched)
    index = held.select("part", "value", F.col("fp").alias("other"), F.col("root").alias("other_root"))
    probes = []
    for i, (bits, threshold) in enumerate(searched):
        flips = [_mask(c) for t in range(threshold + 1) for c in combinations(bits, t)]
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        probes.append(labelled.select("fp", "root", F.lit(i).alias("part"), F.explode(F.array([F.lit(f) for f in flips])).alias("flip"), value.alias("own")).select("fp", "root", "part", F.col("own").bitwiseXOR(F.col("flip")).alias("value")))
    probing = reduce(DataFrame.unionByName, probes)
    # Of each partition value: the component with most holders, and how many there are.
    stats = index.groupBy("part", "value", "other_root").count().groupBy("part", "value").agg(F.max_by("other_root", F.struct("count", "other_root")).alias("major"), F.count("*").alias("roots"))
    both = F.when(F.col("root") == F.col("major"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    probing = probing.join(stats, ["part", "value"]).where((F.col("roots") > 1) | (F.col("root") != F.col("major"))).select("part", "value", "fp", "root", F.explode(both).alias("minor"))
    index = index.join(stats, ["part", "value"]).select("part", "value", "other", "other_root", (F.col("other_root") != F.col("major")).alias("minor"))
    near = (F.col("root") != F.col("other_root")) & (_apart(F.col("fp"), F.col("other")) <= distance)
    same = reduce(Column.__and__, [probing[c] == index[c] for c in ("part", "value", "minor")])
    return probing.join(index, same & near).select(F.col("root").alias("a"), F.col("other_root").alias("b")).distinct()


def _contract(labelled: DataFrame, links: DataFrame, by: str, n: int) -> DataFrame:
    """New roots of the ``n`` fingerprints after links between values of column ``by``."""
    found = components(links).select(F.col("node").alias(by), F.col("root").alias("to"))
    moved = labelled.join(found, by, "left").select("fp", F.coalesce("to", "root").alias("root"))
    return checkpoint(moved.coalesce(1 + n // TASK_LINKS))


def classes(fps: DataFrame, distance: int = DISTANCE, star_turns: int = 2) -> DataFrame:
    """Distinct ``fp`` to ``root``, one value for each set of mutually reachable fingerprints."""
    fps = checkpoint(fps.select("fp").distinct())
    n, sums = moments(fps)
    labelled = fps.withColumn("root", F.col("fp"))
    if n < 2:
        return labelled
    searched = plan(n, sums, distance)
    for turn in range(star_turns):
        before, labelled = labelled, _contract(labelled, stars(labelled, searched, distance, turn), "fp", n)
        release(before)
    before, labelled = labelled, _contract(labelled, probe_links(labelled, searched, distance), "root", n)
    release(before, fps)
    return labelled


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (signed) and component_id: the smallest doc_id that can be reached."""
    own = checkpoint(fingerprints(docs, shingle, seed))
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(classes(own, distance), "fp")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
