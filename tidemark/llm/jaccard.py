"""Near copies: SimHash classes, verified and completed by the Jaccard similarity of word shingles.

A text is the set of its 5-word shingles (all its words if fewer), as 64-bit hashes that
stand for them; words and case are those of ``simhash``. Two texts link at similarity 4/5 or
more.

SimHash. The fingerprints of the same shingles go through the generalised pigeonhole search
of ``simhash``; each text of a class is held against one of the class, and stays with it if
the sets are 4/5 alike. That contracts nearly all copies, groups of thousands included. At 4/5
two SimHashes of 64 bits differ in about ten bits, so the search cannot end there.

What is left. All shingles have one order, with those that a sample of texts shows often at
its end (the sample decides on speed only). Of two sets that link, the first fifths
(``prefix``) share shingles, about a tenth of them if the sets are of one size, so holders of
the same ones are candidates; sizes, the number of shared shingles and the bits of the sets
(their parities differ in no more places than the sets do) rule candidates out, each by an
exact bound. The rest is verified on the whole sets.
A text holds a shingle once, so the rows of one shingle are no more than the texts, a small
part of all prefixes.

Dense groups. Equal sets are one node. As in ``simhash``, holders of a shingle are held
against one of them and the links contracted, and the search goes on between different
components only, where that with most holders of a shingle is not held against itself.

Texts without a word are one node. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import checkpoint, map_arrow, release
from tidemark.llm.components import components
from tidemark.llm.simhash import fold, hashes

SHINGLE = 5
SEED = 42
#: One text of so many, and how many of them make a shingle common: a number, no share, so that
#: the holders of a shingle that is not are no more in a larger table.
SAMPLE, LEAST = 16, 3
#: Common shingles at most; more are ordered like rare ones.
COMMON = 500_000
LANES = [f"b{i}" for i in range(4)]
#: Texts that a dense group is held against in a turn; turns go on while they find more links
#: than one for so many texts.
CENTRES, FEW = 4, 100


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct hashes, ascending."""
    return np.unique(hashes(text, shingle, seed))


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles by (how common, hash): a fifth of them, and one."""
    if not len(found):
        return found
    at = np.searchsorted(common, found)
    often = np.zeros(len(found), np.int64)
    if len(common):
        at[at == len(common)] = 0
        often = np.where(common[at] == found, counts[at], 0)
    return found[np.lexsort((found, often))][: len(found) - (4 * len(found) + 4) // 5 + 1]


def mark(text: Column) -> Column:
    """The hash that stands for a text; null is the empty one."""
    return F.xxhash64(F.lit(SEED), F.coalesce(text.cast("string"), F.lit("")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [shingles(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64))], names=["key"]) if each else pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["key"])

    some = texts.where(F.pmod("mark", F.lit(SAMPLE)) == 0).dropDuplicates(["mark"])
    rows = map_arrow(some, run, "key long").groupBy("key").count().where(F.col("count") >= LEAST).orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    keys, counts = rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _profiles(texts: DataFrame) -> DataFrame:
    """Of each row: mark, node (the hash of the set), its size, SimHash, prefix and bits."""
    held = texts.sparkSession.sparkContext.broadcast(_common(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = held.value
        for batch in batches:
            nodes, sizes, prints, firsts, lanes = [], [], [], [], []
            for t in batch.column(1):
                every = hashes(t.as_py(), SHINGLE, SEED)
                found = np.unique(every)
                prints.append(fold(every))
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                firsts.append(prefix(found, common, counts).view(np.int64))
                odd = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256) & 1
                lanes.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
            ends = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
            flat = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            bits = np.array(lanes, np.int64).reshape(-1, len(LANES))
            columns = [batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(LANES))]], names=["mark", "node", "n", "fp", "prefix", *LANES])

    return map_arrow(texts, run, "mark long, node long, n int, fp long, prefix array<long>, " + ", ".join(f"{c} long" for c in LANES))


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.list_(pa.int64()))], names=["node", "shingles"])

    return map_arrow(texts, run, "node long, shingles array<long>")


def _possible(a: str, b: str) -> Column:
    """Whether two holders can be 4/5 alike, by their sizes and bits."""
    c = lambda side, name: F.col(f"{side}.{name}")
    apart = reduce(Column.__add__, [F.bit_count(c(a, x).bitwiseXOR(c(b, x))) for x in LANES])
    both = c(a, "n") + c(b, "n")
    return (9 * F.least(c(a, "n"), c(b, "n")) >= 4 * both) & (9 * apart <= both)


def _least_shared(a: Column, b: Column) -> Column:
    """How many shingles of their prefixes two sets of these sizes share at least, if they are
    4/5 alike: so many of the shared ones come before either prefix ends."""
    shared = F.floor((4 * (a + b) + 8) / 9)
    ends = lambda n: n - F.floor((4 * n + 4) / 5) + 1
    return F.least(ends(a) - a, ends(b) - b) + shared


def _enough(met: DataFrame, part: int = 1) -> DataFrame:
    """Pairs (a, b) of (a, b, na, nb) rows, one for each shared shingle, that have enough of them."""
    counted = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    return counted.where(part * F.col("shared") >= _least_shared(F.col("na"), F.col("nb"))).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs that are 4/5 alike. Only texts of candidates are hashed again, one for each
    set; equal texts of a task leave it as one."""
    pairs = checkpoint(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = names.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("mark").alias("mark"))
    single = texts.groupBy("mark").agg(F.first("text").alias("text"))
    sets = checkpoint(_sets(single.join(first, "mark").select("node", "text")))
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = checkpoint(pairs.join(side("a"), "a").join(side("b"), "b").where(9 * shared >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"))
    release(pairs, sets)
    return alike


def _merge(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """New roots of the nodes after links between them."""
    end = lambda x: labelled.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    roots = links.join(end("a"), "a").join(end("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b")
    found = components(roots).select(F.col("node").alias("root"), F.col("root").alias("to"))
    moved = checkpoint(labelled.join(found, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    release(labelled, links)
    return moved


def _class_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Each node of a SimHash class, and the first of the class."""
    roots = simhash.classes(nodes.select("fp"), distance)
    held = nodes.select("node", "fp", "n", *LANES).join(roots, "fp")
    first = held.groupBy("root").agg(F.min(F.struct("node", "n", *LANES)).alias("y"), F.count("*").alias("many")).where("many > 1")
    return held.alias("x").join(first, "root").where((F.col("x.node") != F.col("y.node")) & _possible("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _star_pairs(held: DataFrame, turn: int) -> DataFrame:
    """Holders of a shingle against one of them, if of other components: CENTRES different ones
    at most for a group that has many shingles in common."""
    mark = F.xxhash64("node", F.lit(turn), F.pmod("key", F.lit(CENTRES)))
    first = held.groupBy("key").agg(F.min_by(F.struct("node", "n", "root", *LANES), mark).alias("y"))
    other = (F.col("x.root") != F.col("y.root")) & _possible("x", "y")
    met = held.alias("x").join(first, "key").where(other).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    return _enough(met, 2 * CENTRES)  # shingles with this centre are a part of those that are shared


def _other_pairs(held: DataFrame) -> DataFrame:
    """Candidates of different components that share enough of their prefixes: each shared
    shingle gives a pair once."""
    stats = held.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.count("*").alias("roots")).where("roots > 1")
    marked = held.join(stats, "key")
    minor = marked.where("root <> major")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _possible("x", "y")
    least = F.col("x.node") < F.col("y.node")
    side = lambda c, x, y: F.when(least, F.col(x)).otherwise(F.col(y)).alias(c)
    ends = [side("a", "x.node", "y.node"), side("b", "y.node", "x.node"), side("na", "x.n", "y.n"), side("nb", "y.n", "x.n")]
    pair = lambda other, more: minor.alias("x").join(other.alias("y"), near & more).select(*ends)
    return _enough(pair(minor, least).unionByName(pair(marked.where("root = major"), F.lit(True))))


def classes(docs: DataFrame, distance: int = simhash.DISTANCE) -> DataFrame:
    """(mark, root) of each distinct text; texts with the same root can be reached from
    each other over links."""
    texts = _texts(docs)
    own = checkpoint(_profiles(texts))
    names = checkpoint(own.select("mark", "node").distinct())
    nodes = checkpoint(own.groupBy("node").agg(F.min_by(F.struct("n", "fp", "prefix", *LANES), "mark").alias("s")).select("node", "s.*"))
    release(own)
    labelled = checkpoint(nodes.select("node", F.col("node").alias("root")))
    labelled = _merge(labelled, _verified(_class_pairs(nodes, distance), texts, names))
    dealt = nodes.select("node", "n", F.explode("prefix").alias("key")).repartition("key")
    shared = dealt.withColumn("holders", F.count("*").over(W.partitionBy("key"))).where("holders > 1").drop("holders")
    held = checkpoint(shared.join(nodes.select("node", *LANES), "node"))
    release(nodes)
    few, turn, found = names.count() // FEW, 0, None
    while found is None or found > few:
        links = _verified(_star_pairs(held.join(labelled, "node"), turn), texts, names)
        found, turn = links.count(), turn + 1
        labelled = _merge(labelled, links)
    labelled = _merge(labelled, _verified(_other_pairs(held.join(labelled, "node")), texts, names))
    release(held)
    return names.join(labelled, "node").select("mark", "root")
