r"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations only.

A document's paragraphs are its lines; long ones are cut at the first stop (a mark before
white space or the end) that leaves LEAST code points or more, or after MOST without one, so
that words put in change the paragraphs up to the next stop that both versions cut at. Each
distinct paragraph has a 64-bit digest. A sketch has three tables of cells; a digest goes to
one cell of each, which keeps a count, the exclusive or of its digests and that of their
check hashes. Sketches of two versions subtract cell by cell, and what both have cancels. A
cell with count 1 or -1 whose check fits holds one digest that only one version has; taking
it out of its three cells peels the rest.

The fingerprint is the sketch with CELLS cells, as text. Two documents are compared by it;
if it cannot be peeled, by larger ones with other hashes: with room for what its counts
suggest, then for every digest of both, then for twice that (in groups of about GROUP digests by
digest, found in two steps: work grows as the digests times the root of their number). What even that leaves, with odds of less than
one in a million, is counted by set difference. Likeness is the share of common paragraphs among all of both: 1 for equal
texts and for two without a paragraph.

Null texts are empty. The order is by doc_id, nulls first, then by a hash of the text;
repeated rows follow each other. A single row is its own next. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, table

LEAST, MOST = 80, 160
#: A paragraph: of a line, up to a stop, or what there is.
PARAGRAPH = r"[^\n]{%d,%d}?[.!?,;:](?![^ \t\r\n])|[^\n]{1,%d}" % (LEAST - 1, MOST - 1, MOST)
CELLS = 12
GROUP = 64
#: Cells for one digest when a sketch has room for all of them.
ROOM = 1.6
ROUNDS = 40

_CELL = "struct<c:bigint,k:bigint,h:bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(77))


def _entry(key: Column, sign: Column, size: Column, salt: int) -> Column:
    place = [F.pmod(F.xxhash64(key, F.lit(salt), F.lit(t)), size).alias(f"at{t}") for t in range(3)]
    return F.struct(sign.alias("c"), key.alias("k"), _check(key).alias("h"), *place)


def _add(cell: Column, e: Column, sign: int) -> Column:
    return F.struct((cell["c"] + sign * e["c"]).alias("c"), cell["k"].bitwiseXOR(e["k"]).alias("k"), cell["h"].bitwiseXOR(e["h"]).alias("h"))


def _spread(cells: Column, entries: Column, size: Column, sign: int) -> Column:
    """Cells after entries have been put in (or taken out of) all three tables."""

    def table_of(t: int) -> Column:
        def filled(places: Column) -> Column:
            def fill(cell: Column, j: Column) -> Column:
                # Most cells get nothing: the plain search tells them without a lambda.
                own = F.aggregate(F.filter(entries, lambda e: e[f"at{t}"] == j), cell, lambda a, e: _add(a, e, sign))
                return F.when(F.array_contains(places, j.cast("long")), own).otherwise(cell)

            return F.transform(F.slice(cells, (t * size + 1).cast("int"), size.cast("int")), fill)

        return _let(F.transform(entries, lambda e: e[f"at{t}"]), filled)

    return F.concat(*[table_of(t) for t in range(3)])


def sketch(keys: Column, size: Column, salt: int) -> Column:
    """Three tables of ``size`` cells."""
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(n) for n in ("c", "k", "h")]), (3 * size).cast("int"))
    entries = F.transform(keys, lambda k: _entry(k, F.lit(1).cast("long"), size, salt))
    return _let(F.struct(zero.alias("z"), entries.alias("e")), lambda s: _spread(s["z"], s["e"], size, 1))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells: Column, size: Column, salt: int) -> Column:
    """struct(ok, left, right): digests that only the first, only the second version has."""
    none = F.array().cast("array<bigint>")
    start = F.struct(cells.cast(f"array<{_CELL}>").alias("cells"), none.alias("left"), none.alias("right"), F.lit(True).alias("live"))

    def turn(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["h"] == _check(x["k"])))
        # A digest that stands alone in several cells is taken out once.
        alone = F.array_distinct(F.transform(pure, lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"))))

        def taken(some: Column) -> Column:
            entries = F.transform(some, lambda x: _entry(x["k"], x["c"], size, salt))
            ours = F.transform(F.filter(some, lambda x: x["c"] > 0), lambda x: x["k"])
            theirs = F.transform(F.filter(some, lambda x: x["c"] < 0), lambda x: x["k"])
            out = _let(entries, lambda e: _spread(state["cells"], e, size, -1))
            return F.struct(out.alias("cells"), F.concat(state["left"], ours).alias("left"), F.concat(state["right"], theirs).alias("right"), (F.size(some) > 0).alias("live"))

        halted = F.struct(state["cells"].alias("cells"), state["left"].alias("left"), state["right"].alias("right"), F.lit(False).alias("live"))
        return F.when(state["live"], _let(alone, lambda some: F.when(F.size(some) > 0, taken(some)).otherwise(halted))).otherwise(halted)

    def done(state: Column) -> Column:
        clean = F.forall(state["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0))
        return F.struct(clean.alias("ok"), state["left"].alias("left"), state["right"].alias("right"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, done)


def compare(rows: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Adds ``name``, struct(ok, left, right): the digests that only one of two texts has.

    ``rows`` has <text>_keys and <text>_cells of both. Every step is a column of its own and
    is null, or copied, where an earlier one has peeled all.
    """
    a, b = F.col(f"{left}_keys"), F.col(f"{right}_keys")
    size = F.lit(CELLS // 3).cast("long")
    rows = rows.withColumn("_diff", subtract(F.col(f"{left}_cells"), F.col(f"{right}_cells")))
    # Signs are as good as random, so the squared counts of a table add up to the number of
    # differing digests on average: the first retry has room for some more than that.
    guess = F.aggregate("_diff", F.lit(0).cast("long"), lambda s, c: s + c["c"] * c["c"]) / 3.0 * 2 + 8
    rows = rows.withColumn("_guess", guess).withColumn(name, peel(F.col("_diff"), size, 0)).drop("_diff")
    every = (F.size(a) + F.size(b)).cast("double")
    for salt, most in ((1, F.least(F.col("_guess"), every)), (2, every), (3, 2 * every)):
        todo = ~F.col(f"{name}.ok")
        wide = F.ceil(F.sqrt(F.ceil(F.greatest(every, F.lit(1.0)) / GROUP))).cast("long")
        groups = wide * F.ceil(F.ceil(F.greatest(every, F.lit(1.0)) / GROUP) / wide).cast("long")
        room = F.ceil(most / groups * (ROOM / 3) + 4).cast("long")
        rows = rows.withColumns({"_n": F.when(todo, groups), "_wide": F.when(todo, wide), "_size": F.when(todo, room)})

        def dealt(keys: Column) -> Column:
            upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
            group = lambda k: F.pmod(k, F.col("_n"))
            # By rows of groups first, then by groups of a row: no key is looked at for each group.
            rough = F.transform(upto(F.floor(F.col("_n") / F.col("_wide"))), lambda r: F.filter(keys, lambda k: F.floor(group(k) / F.col("_wide")) == r))
            fine = F.transform(rough, lambda some: F.transform(upto(F.col("_wide")), lambda c: F.filter(some, lambda k: F.pmod(group(k), F.col("_wide")) == c)))
            return F.when(F.col("_n") == 1, F.array(keys)).otherwise(F.flatten(fine))

        rows = rows.withColumns({"_a": dealt(a), "_b": dealt(b)})
        rows = rows.withColumns({c: F.transform(c, lambda keys: sketch(keys, F.col("_size"), salt)) for c in ("_a", "_b")})  # noqa: B023
        rows = rows.withColumn("_cells", F.zip_with("_a", "_b", subtract)).drop("_a", "_b")
        rows = rows.withColumn("_parts", F.transform("_cells", lambda cells: peel(cells, F.col("_size"), salt))).drop("_cells")  # noqa: B023
        joined = F.struct(
            F.forall("_parts", lambda p: p["ok"]).alias("ok"),
            F.flatten(F.transform("_parts", lambda p: p["left"])).alias("left"),
            F.flatten(F.transform("_parts", lambda p: p["right"])).alias("right"),
        )
        rows = rows.withColumn(name, F.when(todo, joined).otherwise(F.col(name))).drop("_parts", "_n", "_wide", "_size")
    exact = F.struct(F.lit(True).alias("ok"), F.array_except(a, b).alias("left"), F.array_except(b, a).alias("right"))
    return rows.withColumn(name, F.when(F.col(f"{name}.ok"), F.col(name)).otherwise(exact)).drop("_guess")


def likeness(a: Column, diff: Column) -> Column:
    every = F.size(a) + F.size(diff["right"])
    return F.when(every == 0, F.lit(1.0)).otherwise((F.size(a) - F.size(diff["left"])) / F.greatest(every, F.lit(1)).cast("double"))


def as_text(cells: Column) -> Column:
    """Cells as hexadecimal text: count, digest and check."""
    digits = lambda x, n: F.right(F.lpad(F.hex(x), 16, "0"), F.lit(n))
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat(digits(c["c"], 4), digits(c["k"], 16), digits(c["h"], 8))), ""))


#: Parts, by hash of the text, of the rows without an id and of those of an id that is very common.
PARTS = 64


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text that follows in doc_id order, the first after the last.

    Documents are dealt to ranges of doc_id, many for each task, and rows of a null or a very
    common id to ranges of their texts' hashes, by which they are ordered; each range also gets
    the first row of the next one, whose place is two numbers for each range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    wide = min(2000, 8 * partitions(docs.sparkSession))
    ids = rows.select("doc_id", "mark")
    quantiles = list(map(int, ids.approxQuantile("doc_id", [k / wide for k in range(1, wide)], 1 / (4 * wide))))
    cuts = sorted(set(quantiles))
    common = [c for c in cuts if quantiles.count(c) > 2]
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    part = F.shiftrightunsigned(F.col("mark").bitwiseXOR(F.lit(-(1 << 63))), 58)  # 0 .. PARTS - 1, ascending
    common = F.col("doc_id").isin(common) if common else F.lit(False)
    # A common id is the first of its range; what follows it there comes after all its parts.
    bucket = F.when(F.col("doc_id").isNull(), part - PARTS - 1).otherwise(place * (PARTS + 1) + F.when(common, part).otherwise(PARTS)).cast("long")
    first = F.min(F.struct("doc_id", "mark")).alias("head")
    heads = sorted((r["bucket"], r["head"]["doc_id"], r["head"]["mark"]) for r in ids.withColumn("bucket", bucket).groupBy("bucket").agg(first).collect())
    held = rows.withColumn("bucket", bucket).withColumn("ghost", F.lit(False))
    if heads:
        before = [b for b, *_ in heads[-1:] + heads[:-1]]
        to = F.create_map(*[F.lit(x) for (b, *_), p in zip(heads, before, strict=True) for x in (b, p)])
        known = F.create_map(*[x for b, i, m in heads for x in (F.lit(b), F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(m).alias("mark")))])
        found = F.transform(F.array(F.struct(to.alias("to"), known.alias("known"))), lambda m: F.struct(m["to"][F.col("bucket")].alias("to"), m["known"][F.col("bucket")].alias("head")))
        ghosts = held.withColumn("next", F.get(found, F.lit(0))).where(F.col("next.head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("next.head.mark") == F.col("mark")))
        held = held.unionByName(ghosts.select("doc_id", "text", "mark", F.col("next.to").alias("bucket"), F.lit(True).alias("ghost")))
    order = W.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "mark")
    return held.withColumn("next_text", F.lead("text").over(order)).where("not ghost").select("doc_id", "text", "next_text")


def fingerprints(pairs: DataFrame, *texts: str) -> DataFrame:
    """Adds ``<text>_keys`` and ``<text>_cells`` for each text column."""
    out = pairs.withColumns({f"{t}_keys": paragraphs(F.col(t)) for t in texts})
    return out.withColumns({f"{t}_cells": sketch(F.col(f"{t}_keys"), F.lit(CELLS // 3).cast("long"), 0) for t in texts})


def op2_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("next_text").substr(F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    rows = fingerprints(rows, "text", "next_text", "edited").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("text", "next_text", "edited")
    rows = compare(compare(rows, "text", "edited", "to_edited"), "text", "next_text", "to_next")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("text_cells")).alias("fingerprint"),
        as_text(F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("text_keys"), F.col("to_edited")).alias("near_edited"),
        likeness(F.col("text_keys"), F.col("to_next")).alias("near_next"),
    )
