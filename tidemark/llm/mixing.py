"""Mixing sources to target weights, in DataFrame operations only.

Sizes are words. Targets: sources in code point order, nulls last, weigh 5, 2, 1, repeating;
they share ``share`` of all words by weight, a source stops at ``most`` times its own words,
and what it cannot take is shared again. That is one water level: sorted by their stop per
weight, a prefix of the sources stops and the rest take the level times their weight.

Blocks. A source's documents fall into blocks by a hash of id and text, as many as its words
(or its documents, if most are empty) ask for. Its
blocks stand in a random (hashed) order, and so do the documents of a block; the source
takes whole rounds of all its blocks and then, from the start of that order, exactly the
words that are still missing; the document at which they end is cut.

Shards. A round's block is one unit of the source's exact quota. A splitting tree divides
all quotas among the output shards: a node's units go to its two halves by a multivariate
hypergeometric draw (source by source, by the inverse of the distribution function), so the
counts of each source add up exactly on every level. A shard then takes the next so many
units in each source's permuted order: the draws are disjoint. Inside a shard, documents
are ordered by a hash, which is the local shuffle.

Nothing is random but hashes of ``seed``, so reruns agree. A hot source is many blocks, as
many as its words ask for; a window spans one block's documents, up to about TOGETHER blocks
of a source, or a source's groups of them. The tree holds a number for each source in a row.

Null texts have size 0 and take nothing; a null source is a source; null ids keep their row.
Rows that share an id, or have none, are told by their texts; full ties are each other's
equals. Sources without words have target 0. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SHARD_LEVELS = 4
#: Words of a block, and blocks of a source that are put in order together.
BLOCK_WORDS = 50_000
TOGETHER = 4096
#: Standard deviations around the mean that a hypergeometric draw looks at.
SPREAD = 8
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) rows to source, source_size, documents, target: one row for each source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    # One row for each source from here on, so these windows hold metadata, not documents.
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    stop = F.col("source_size") * F.lit(float(most))
    known = sources.select("source", "source_size", "documents", weight.alias("weight"), stop.alias("stop")).withColumn("ratio", F.col("stop") / F.col("weight"))
    every = W.partitionBy(F.lit(0))
    before = every.orderBy("ratio", "weight", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = known.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum("stop").over(before), F.lit(0.0)).alias("stopped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    # The first source, in this order, whose stop is not below the level sets it for the rest.
    here = (F.col("total") - F.col("stopped")) / F.col("open")
    water = F.min(F.when(here <= F.col("ratio"), F.struct("ratio", here.alias("level")))).over(every)["level"]
    return level.select("source", "source_size", "documents", F.least(F.col("stop"), F.col("weight") * F.coalesce(water, F.lit(float("inf")))).alias("target"))


def _uniform(*on: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*on), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def _hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` units without replacement out of ``total`` are among ``good``.

    Weights relative to the mode follow from the ratio of neighbours; they are summed over
    a window of SPREAD standard deviations, outside of which they vanish in a double.
    """
    g, n, d = good.cast("double"), total.cast("double"), draws.cast("double")
    low, high = F.greatest(F.lit(0.0), d + g - n), F.least(g, d)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (g + 1) / (n + 2)).cast("double")))
    spread = F.ceil(SPREAD * F.sqrt(F.greatest(F.lit(0.0), d * g / F.greatest(n, F.lit(1.0)) * (n - g) / F.greatest(n, F.lit(1.0)) * (n - d) / F.greatest(n - 1, F.lit(1.0)))) + 4).cast("double")

    def drawn(s: Column) -> Column:
        """Of a struct with all of the above, so that each is computed once."""

        def fold(first: Column, last: Column, step: int) -> Column:
            """Cumulated weights going away from the mode."""

            def add(state: Column, k: Column) -> Column:
                up = (s["g"] - k + 1) * (s["d"] - k + 1) / (k * (s["n"] - s["g"] - s["d"] + k))
                down = (k + 1) * (s["n"] - s["g"] - s["d"] + k + 1) / ((s["g"] - k) * (s["d"] - k))
                w = state["w"] * (up if step > 0 else down)
                return F.struct(w.alias("w"), F.concat(state["all"], F.array(w)).alias("all"))

            many = F.when(step * (last - first) >= 0, F.transform(F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long")), lambda k: k.cast("double"))).otherwise(F.array().cast("array<double>"))
            return F.aggregate(many, F.struct(F.lit(1.0).alias("w"), F.array().cast("array<double>").alias("all")), add)["all"]

        upper = fold(s["mode"] + 1, F.least(s["high"], s["mode"] + s["spread"]), 1)
        lower = fold(s["mode"] - 1, F.greatest(s["low"], s["mode"] - s["spread"]), -1)
        odds = F.concat(F.reverse(lower), F.array(F.lit(1.0)), upper)

        def pick(held: Column) -> Column:
            """How many of the values lie wholly below the cut."""
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k"))

            def count(a: Column, x: Column) -> Column:
                return F.struct((a["sum"] + x).alias("sum"), (a["k"] + F.when(a["sum"] + x < held["cut"], 1).otherwise(0)).alias("k"))

            return F.aggregate(held["odds"], start, count)["k"]

        first = F.greatest(s["low"], s["mode"] - s["spread"]).cast("long")
        total_odds = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
        return F.transform(F.array(F.struct(odds.alias("odds"), (total_odds * s["u"]).alias("cut"))), lambda h: F.least(s["high"].cast("long"), first + pick(h)))[0]

    bound = F.struct(g.alias("g"), n.alias("n"), d.alias("d"), low.alias("low"), high.alias("high"), mode.alias("mode"), spread.alias("spread"), u.alias("u"))
    return F.transform(F.array(bound), drawn)[0]


def _split(quotas: Column, node: Column, seed: int) -> Column:
    """Units of each source that go to the left half of a node: half of all of them."""
    whole = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(F.floor(whole / 2).cast("long").alias("draws"), whole.alias("units"), F.lit(0).alias("i"), F.array().cast("array<long>").alias("left"))

    def step(state: Column, q: Column) -> Column:
        x = _hypergeometric(q, state["units"], state["draws"], _uniform(F.lit(seed), node, state["i"]))
        return F.transform(F.array(x), lambda k: F.struct((state["draws"] - k).alias("draws"), (state["units"] - q).alias("units"), (state["i"] + 1).alias("i"), F.concat(state["left"], F.array(k)).alias("left")))[0]

    return F.aggregate(quotas, start, step)["left"]


def splitting_tree(quotas: DataFrame, levels: int = SHARD_LEVELS, seed: int = SEED) -> DataFrame:
    """(key, units) rows to (key, shard_ends): cumulated units of the 2**levels shards.

    One row holds the units of all sources: as many numbers as there are sources.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("key", "units"))).alias("all"))
    nodes = nodes.select(F.transform("all", lambda x: x["key"]).alias("keys"), F.transform("all", lambda x: x["units"]).alias("units"), F.lit(1).cast("long").alias("node"))
    for _ in range(levels):
        halved = nodes.withColumn("left", _split(F.col("units"), F.col("node"), seed))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("units")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("units", "left", lambda a, b: a - b).alias("units")),
        )
        nodes = halved.select("keys", F.explode(halves).alias("half")).select("keys", "half.units", "half.node")
    each = nodes.select("node", F.explode(F.arrays_zip("keys", "units")).alias("z")).select("node", F.col("z.keys").alias("key"), F.col("z.units").alias("units"))
    ordered = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "units"))).alias("shards"))
    return ordered.select("key", F.transform(F.sequence(F.lit(1), F.size("shards")), lambda i: F.aggregate(F.slice("shards", 1, i), F.lit(0).cast("long"), lambda a, s: a + s["units"])).alias("shard_ends"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    levels: int = SHARD_LEVELS,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every document with size, source_size, target, taken and its copies.

    ``copies`` has a (shard, words, place) for each time the document is used, words being
    fewer than its size for the one that is cut; sorting a shard by place is its shuffle.
    ``keep`` names further columns to carry along.
    """
    own = [F.col(c) for c in keep]
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("mark")
    sizes = checkpoint(docs.select("doc_id", "source", words(F.col("text")).alias("size"), mark, *own))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key")
    goal = targets(sizes, weights, share, most).select(
        key,
        "source_size",
        "target",
        F.round("target").cast("long").alias("goal"),
        F.greatest(F.lit(1), F.ceil(F.greatest("source_size", "documents") / BLOCK_WORDS)).cast("long").alias("n_blocks"),
    )
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    # A table of its own, of known size: documents meet it by a broadcast if it is small.
    goal = checkpoint(goal.withColumn("rounds", rounds).withColumn("missing", F.col("goal") - F.col("rounds") * F.col("source_size")))
    placed = sizes.select("*", key).join(goal, "key").withColumn("block", F.pmod("mark", F.col("n_blocks")))
    order = F.xxhash64(F.lit(seed + 1), "key", "block")
    blocks = placed.groupBy("key", "block").agg(F.sum("size").alias("block_words"), *[F.first(c).alias(c) for c in ("missing", "rounds", "n_blocks")])
    # The order of a source's blocks is by group and then inside it, so no window holds them all.
    blocks = blocks.select("*", F.pmod(order, F.ceil(F.col("n_blocks") / TOGETHER)).cast("long").alias("group"), order.alias("order"))
    together = W.partitionBy("key", "group")
    blocks = blocks.select("*", F.sum("block_words").over(together.orderBy("order", "block")).alias("until"), F.row_number().over(together.orderBy("order", "block")).alias("number"))
    groups = blocks.groupBy("key", "group").agg(F.sum("block_words").alias("words"), F.count("*").alias("many"))
    by_source = W.partitionBy("key")
    before = by_source.orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("key", "group", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"), F.coalesce(F.sum("many").over(before), F.lit(0)).alias("many_before"), F.sum("many").over(by_source).alias("present"))
    blocks = blocks.join(groups, ["key", "group"]).select(
        "key",
        "block",
        (F.col("words_before") + F.col("until") - F.col("block_words")).alias("block_start"),
        (F.col("many_before") + F.col("number") - 1).cast("long").alias("position"),
        "present",
        "missing",
        "rounds",
    )
    units = blocks.groupBy("key").agg((F.first("rounds") * F.first("present") + F.sum((F.col("block_start") < F.col("missing")).cast("long"))).alias("units"))
    blocks = blocks.drop("missing", "rounds").join(splitting_tree(units, levels, seed), "key")
    inside = W.partitionBy("key", "block").orderBy(F.xxhash64(F.lit(seed + 2), "mark"), "mark", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    # Dealt by block, else a window would take rows dealt by source as they are: a hot one in one task.
    found = placed.repartition("key", "block").join(blocks, ["key", "block"]).withColumn("at", F.col("block_start") + F.sum("size").over(inside) - F.col("size"))
    found = found.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("missing") - F.col("at"))))

    def copy(turn: Column) -> Column:
        unit = turn * F.col("present") + F.col("position")
        shard = F.size(F.filter("shard_ends", lambda e: e <= unit))
        taken = F.when(turn < F.col("rounds"), F.col("size")).otherwise(F.col("extra"))
        return F.struct(shard.alias("shard"), taken.alias("words"), F.xxhash64(F.lit(seed + 3), F.col("mark"), turn).alias("place"))

    turns = F.sequence(F.lit(0).cast("long"), F.col("rounds"))
    copies = F.filter(F.transform(turns, copy), lambda c: c["words"] > 0)
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("extra")).alias("taken"), copies.alias("copies"), *own)


def op5_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.transform("copies", lambda c: c["shard"]).alias("shards"))
