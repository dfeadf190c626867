r"""Quotation linking of conversations, in DataFrame operations only.

A line's quote level is the number of ``>`` it starts with (blanks between them allowed).
A passage is a run of lines of one level, ended by a line of another level or without a
word, joined by blanks; normalised, it is in lower case with runs of white space as one
blank. Passages of level 0, and their single lines, are a message's own; those of level 1
and more are quotes. A quoted passage, or if the passage as a whole is unknown its single
lines, links to the earliest message of the same conversation that has it as its own, if
that is an earlier turn. Hashes of the normalised passages are joined; the earliest message
of each hash is found by a partial minimum first, so the join is many to one and a passage
that thousands of messages hold is one row on its side.

A message replies to the latest of the messages that its level-1 quotes link to; without
such a link it starts a thread. ``root_turn`` is the turn that starts its thread (found by
pointer doubling) and ``depth`` its distance from there. ``position`` is the message's place,
from 1, in the reply order of its conversation, by (root_turn, turn). ``body`` is the text
without quoted lines.

Null texts are empty; a null conv_id or turn links to nothing and has no position; white space is [ \t-\r].
Rows that repeat a (conv_id, turn) are each returned and share that turn's parent, the
latest of all, and its position. An empty table gives no rows; other columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import let
from tidemark.llm.common import checkpoint, release, table
from tidemark.operators.graph import number

_MARKS = r"^[\x20\x09]*(>[\x20\x09]*)*"
_SPACE = r"[\x20\x09-\x0D]+"
#: Doublings of the reply pointers at most: threads of up to 2**40 messages.
DOUBLINGS = 40


def _normal(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, _SPACE, " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds ``lines`` (level, raw, text) and ``runs`` (level, text, lines) of every message."""
    lines = F.transform(
        F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", "")).alias("level"),
            line.alias("raw"),
            _normal(F.regexp_replace(line, _MARKS, "")).alias("text"),
        ),
    )

    def runs_of(lines: Column) -> Column:
        """From where a run starts to where it ends: no step copies what others found."""
        at = lambda i: F.get(lines, i)
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        joins = lambda i, k: F.coalesce((at(k)["text"] != "") & (at(k)["level"] == at(i)["level"]), F.lit(False))
        starts = F.filter(every, lambda i: (at(i)["text"] != "") & ~joins(i, i - 1))
        ends = F.filter(every, lambda i: (at(i)["text"] != "") & ~joins(i, i + 1))

        def run(a: Column, b: Column) -> Column:
            texts = F.transform(F.slice(lines, a + 1, b - a + 1), lambda line: line["text"])
            return F.struct(at(a)["level"].alias("level"), F.array_join(texts, " ").alias("text"), texts.alias("lines"))

        return F.zip_with(starts, ends, run)

    return messages.withColumn("lines", lines).withColumn("runs", let(F.col("lines"), runs_of))


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def link(messages: DataFrame) -> DataFrame:
    """One row for each message: its quotes, links, place in reply order and body."""
    rows = parsed(messages.select("conv_id", "turn", "role", "text"))
    runs = rows.select("conv_id", "turn", F.explode("runs").alias("run"))
    units = F.when(F.size("run.lines") > 1, F.concat(F.array("run.text"), F.col("run.lines"))).otherwise(F.array("run.text"))
    own = runs.where("run.level = 0").select("conv_id", "turn", F.explode(units).alias("unit"))
    origin = own.groupBy("conv_id", _hash(F.col("unit")).alias("hash")).agg(F.min("turn").alias("origin"))
    whole = runs.where("run.level > 0").select("conv_id", "turn", "run", _hash(F.col("run.text")).alias("hash"))
    # The passage as a whole (rank 0), and its lines (rank 1), each with where it comes from.
    asked = whole.select("conv_id", "turn", "run.level", F.col("hash").alias("passage"), F.explode(F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("hash"))), F.transform("run.lines", lambda t: F.struct(F.lit(1).alias("rank"), _hash(t).alias("hash"))))).alias("u")).select("conv_id", "turn", "level", "passage", "u.rank", "u.hash")
    met = asked.join(origin, ["conv_id", "hash"]).where("origin < turn")
    best = met.groupBy("conv_id", "turn", "level", "passage").agg(F.max_by("origin", F.struct(-F.col("rank"), F.col("origin"))).alias("origin"))
    linked = best.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("parent_turn"))
    linked = checkpoint(linked)
    roots = _roots(linked.where("parent_turn is not null").select("conv_id", "turn", "parent_turn"))
    turns = messages.select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct()
    placed = turns.join(linked, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left").withColumn("root_turn", F.coalesce("root_turn", "turn"))
    # Numbered over all conversations by ranges of the order, so a long one is no single task.
    numbered = number(placed, ["conv_id", "root_turn", "turn"], "place")
    first = numbered.groupBy("conv_id").agg(F.min("place").alias("first"))
    placed = numbered.join(first, "conv_id").withColumn("position", F.col("place") - F.col("first") + 1)
    quotes = F.filter("runs", lambda r: r["level"] > 0)
    kept = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["raw"])
    seen = rows.select(
        "conv_id",
        "turn",
        "role",
        F.size(quotes).cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("runs", lambda r: r["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.array_join(kept, "\n").alias("body"),
    )
    out = seen.join(placed, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "max_level",
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "position",
        "body",
    )


def _roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) to root_turn and depth, by pointer doubling."""
    at = replies.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    for _ in range(DOUBLINGS + 1):
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        moved = at.join(up, ["conv_id", "root_turn"], "left")
        before, at = at, checkpoint(moved.select("conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")))
        release(before)
        if at.where("moved").isEmpty():
            return at.select("conv_id", "turn", "root_turn", "depth")
    raise RuntimeError(f"threads of more than 2**{DOUBLINGS} messages")


def op8_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))


OP8_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT rid, conv_id, turn, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM m),
n AS (SELECT rid, conv_id, turn, raw, i,
             length(regexp_replace(regexp_extract(raw, '^[\x20\x09]*(>[\x20\x09]*)*', 0), '[^>]', '', 'g')) AS level,
             trim(lower(regexp_replace(regexp_replace(raw, '^[\x20\x09]*(>[\x20\x09]*)*', ''), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS txt FROM l),
b AS (SELECT *, CASE WHEN txt <> '' AND lag(txt) OVER w <> '' AND lag(level) OVER w = level THEN 0 ELSE 1 END AS fresh FROM n WINDOW w AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM b),
r AS (SELECT rid, conv_id, turn, run, min(level) AS level, string_agg(txt, ' ' ORDER BY i) AS txt, count(*) AS k FROM g WHERE txt <> '' GROUP BY ALL),
own AS (SELECT conv_id, turn, txt FROM r WHERE level = 0 UNION ALL SELECT conv_id, turn, txt FROM g WHERE level = 0 AND txt <> ''),
origin AS (SELECT conv_id, txt, min(turn) AS origin FROM own GROUP BY 1, 2),
asked AS (SELECT conv_id, turn, level, txt AS passage, 0 AS rank, txt FROM r WHERE level > 0
          UNION ALL SELECT r.conv_id, r.turn, r.level, r.txt, 1, g.txt FROM r JOIN g USING (rid, run) WHERE r.level > 0 AND g.txt <> ''),
met AS (SELECT a.*, origin FROM asked a JOIN origin o ON a.conv_id = o.conv_id AND a.txt = o.txt WHERE origin < turn),
best AS (SELECT conv_id, turn, level, passage, arg_max(origin, -rank * 1000000000 + origin) AS origin FROM met GROUP BY 1, 2, 3, 4),
linked AS (SELECT conv_id, turn, count(*) AS n_linked, max(CASE WHEN level = 1 THEN origin END) AS parent_turn FROM best GROUP BY 1, 2),
up AS (SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM linked WHERE parent_turn IS NOT NULL
       UNION ALL SELECT u.conv_id, u.turn, k.parent_turn, u.depth + 1 FROM up u JOIN linked k ON k.conv_id = u.conv_id AND k.turn = u.root_turn WHERE k.parent_turn IS NOT NULL),
roots AS (SELECT conv_id, turn, min(root_turn) AS root_turn, max(depth) AS depth FROM up GROUP BY 1, 2),
q AS (SELECT rid, count(*) FILTER (WHERE level > 0) AS n_quotes, max(level) AS max_level FROM r GROUP BY 1),
spot AS (SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY root_turn, turn) AS position
         FROM (SELECT DISTINCT m.conv_id, m.turn, coalesce(s.root_turn, m.turn) AS root_turn FROM m LEFT JOIN roots s ON s.conv_id = m.conv_id AND s.turn = m.turn WHERE m.conv_id IS NOT NULL AND m.turn IS NOT NULL)),
body AS (SELECT rid, string_agg(raw, chr(10) ORDER BY i) AS body FROM g WHERE level = 0 GROUP BY 1)
SELECT m.conv_id, m.turn, m.role, CAST(coalesce(q.n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
       CAST(coalesce(q.max_level, 0) AS BIGINT) AS max_level, parent_turn, coalesce(root_turn, m.turn) AS root_turn,
       CAST(coalesce(depth, 0) AS BIGINT) AS depth, CAST(spot.position AS BIGINT) AS position, coalesce(body.body, '') AS body
FROM m LEFT JOIN q USING (rid) LEFT JOIN body USING (rid)
LEFT JOIN linked k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN roots s ON s.conv_id = m.conv_id AND s.turn = m.turn
LEFT JOIN spot ON spot.conv_id = m.conv_id AND spot.turn = m.turn
"""
