"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, map_arrow, release

#: Rounds from which something is wrong: each at least halves the depth of the label trees.
ROUNDS = 64
#: Links that are contracted together in a task, which bounds its memory; few links need few tasks.
TASK_LINKS = 50_000


def contracted(links: DataFrame, together: int) -> DataFrame:
    """Of every ``together`` links that a task reads, the components, as (node, smallest of it):
    no more links than before, with the same ends in reach of each other."""

    def forest(held: list[tuple[int, int]]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in held:
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        rows = [(x, find(x)) for x in parent]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            while len(held) >= together:
                yield forest(held[:together])
                held = held[together:]
        yield forest(held)

    return map_arrow(links.select("a", "b"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of longs to (node, root): the smallest node reachable.

    Tasks contract the links that they read. Where more than one task has some, alternating
    large-star and small-star steps follow: each node links its larger neighbours, then its
    smaller ones, to the smallest node it knows. The number of links never grows, a hub is
    only ever a grouping key with a partial minimum, and few rounds are needed. Null ends link
    to nothing; repeated links and loops count once; no links give no rows.
    """
    every = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    n = every.count()
    edges = checkpoint(contracted(every.coalesce(1 + n // TASK_LINKS), TASK_LINKS))
    release(every)
    if n < TASK_LINKS:  # one task has seen them all
        return edges.withColumnsRenamed({"a": "node", "b": "root"})
    before = _state(edges)
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        moved = checkpoint(small.coalesce(1 + before[0] // TASK_LINKS))
        release(edges)
        edges, state = moved, _state(moved)
        if state == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        before = state
    raise RuntimeError(f"no components after {ROUNDS} rounds")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
