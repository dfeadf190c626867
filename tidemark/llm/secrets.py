"""Secret scans with an incremental blob ledger, in DataFrame operations only.

A blob is the SHA-256 of a text; a path is a document (or any version of one). The ledger
holds, for each pair of blob and rule version, the findings. A scan takes the blobs that
occur, drops the pairs that the ledger has, scans each remaining blob once under the rules
that it lacks, and joins the findings back to every path of the blob.

Copies in thousands are scanned once: one path is chosen for each blob by a partial
minimum, and texts move only if the ledger lacks something of them. The join of the findings
back to paths carries hashes and spans, no texts.

A rule is (kind, version, pattern, group, least): ``pattern`` is matched leftmost and without
overlaps over the whole text, and a match is kept if its ``group`` has ``least`` characters
or more; one that fails is passed over as a whole. Spans are in code points, end exclusive.
The base rules define the counts; the added one finds credentials by their issuers' forms,
wherever they stand, so its spans may lie inside base ones.

Null texts are empty texts. Repeated paths each get their rows; an empty table gives none;
spans that start together are ordered as the rules are listed; other columns are kept out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import let, running
from tidemark.llm.common import checkpoint, table


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The patterns that the results are defined by.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
# A run of [0-9a-f] shorter than 32 never matches, so the last rule may ask for 32 at once.

# Public forms of issued credentials.
ISSUED = (
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{60,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"xox[abprs]-[A-Za-z0-9-]{20,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"(?:sk|rk)_live_[A-Za-z0-9]{20,}",
    r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)
ADDED = (Rule("issued", 1, "|".join(ISSUED), 0, 20),)

LEDGER = "blob string, kind string, version int, spans array<struct<start:long,end:long>>"


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _spans(text: Column, rule: Rule) -> Column:
    """Kept spans of a rule: the texts between matches alternate with the matches."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def measured(gap: Column, m: Column) -> Column:
        kept = F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least
        size = F.length(m).cast("long")
        return F.struct((F.length(gap) + size).alias("step"), size.alias("size"), kept.alias("kept"))

    def located(found: Column) -> Column:
        ends = running(F.transform(found, lambda m: m["step"]))
        spans = F.zip_with(found, ends, lambda m, end: F.struct((end - m["size"]).alias("start"), end.alias("end"), m["kept"].alias("kept")))
        return F.transform(F.filter(spans, lambda s: s["kept"]), lambda s: F.struct(s["start"], s["end"]))

    def alternating(matches: Column) -> Column:
        between = F.split(text, rule.pattern, -1)
        return F.when(F.size(matches) > 0, let(F.zip_with(F.slice(between, 1, F.size(matches)), matches, measured), located)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), alternating)


def scan_texts(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, lacking) rows to ledger rows: one for each lacking rule, with or without spans."""
    each = [F.when(F.array_contains("lacking", F.lit(i)), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("text"), r).alias("spans"))) for i, r in enumerate(rules)]
    found = texts.select("blob", F.explode(F.array(*each)).alias("f")).where("f is not null")
    return found.select("blob", "f.kind", "f.version", "f.spans")


@dataclass(frozen=True)
class Scan:
    """``paths``: (doc_id, blob) of every row; ``known``: ledger rows of all blobs that
    occur or ever did; ``new``: those of them that this scan adds to the ledger."""

    paths: DataFrame
    known: DataFrame
    new: DataFrame

    def findings(self) -> DataFrame:
        """(doc_id, blob, kind, version, spans) for every path and rule."""
        return self.paths.join(self.known, "blob").select("doc_id", "blob", "kind", "version", "spans")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> Scan:
    """Scan what the ledger lacks; the caller appends ``new`` to it."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", blob(F.col("text")))
    paths = texts.select("doc_id", "blob")
    chosen = paths.groupBy("blob").agg(F.min(F.struct("doc_id")).alias("s")).select(F.col("blob").alias("of"), F.col("s.doc_id").alias("path"))
    every = F.array(*[F.lit(i) for i in range(len(rules))])
    if ledger is None:
        new = _scan_chosen(texts, chosen.withColumn("lacking", every), rules)
        return Scan(paths, new, new)
    number = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)])
    current = ledger.withColumn("rule", number).where("rule is not null")
    have = current.groupBy(F.col("blob").alias("of")).agg(F.collect_set("rule").alias("have"))
    lacking = F.array_except(every, F.coalesce("have", F.array().cast("array<int>")))
    chosen = chosen.join(have, "of", "left").select("of", "path", lacking.alias("lacking")).where("size(lacking) > 0")
    new = _scan_chosen(texts, chosen, rules)
    return Scan(paths, new.unionByName(current.drop("rule").select("blob", "kind", "version", "spans")), new)


def _scan_chosen(texts: DataFrame, chosen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Each chosen blob's text from its path; a row that is repeated as it is counts once."""
    one = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("path")) & (F.col("blob") == F.col("of"))).select("blob", "text", "lacking")
    return scan_texts(one, rules).dropDuplicates(["blob", "kind", "version"])


def digests(known: DataFrame, rules: tuple[Rule, ...] = RULES, added: tuple[Rule, ...] = ()) -> DataFrame:
    """One row for each blob: spans as kind:start:end in order, the hash of those of ``rules``,
    counts by kind."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules + added) for x in (r.kind, i)])
    flat = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("rank"), F.concat_ws(":", F.col("kind"), s["start"].cast("string"), s["end"].cast("string")).alias("said")))
    counts = [F.sum(F.when(F.col("kind") == r.kind, F.size("spans")).otherwise(0)).cast("long").alias(f"n_{r.kind}") for r in rules + added]
    by_blob = known.withColumn("flat", flat).groupBy("blob").agg(*counts, F.array_sort(F.flatten(F.collect_list("flat"))).alias("all"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: s["said"]), ",")
    base = said(F.filter("all", lambda s: s["rank"] < len(rules)))
    return by_blob.select("blob", *[f"n_{r.kind}" for r in rules + added], F.sha2(base.cast("binary"), 256).alias("base_sha256"), said(F.col("all")).alias("spans"))


def op7_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a scan under the base rules; then a scan with one rule more, which has only
    the pairs of that rule left to do."""
    docs = table(spark, sf_dir, "documents")
    ledger = checkpoint(scan(docs, None, RULES).new)
    found = scan(docs, ledger, RULES + ADDED)
    names = [f"n_{r.kind}" for r in RULES]
    return found.paths.join(digests(found.known, RULES, ADDED), "blob").select("doc_id", *names, "base_sha256", "spans", *[f"n_{r.kind}" for r in ADDED])
