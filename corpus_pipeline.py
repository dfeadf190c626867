"""A training-data pipeline over ``documents``: five stages, each one operator's decisions.

language_id    documents without a letter, or that the byte network is unsure about, go
near_dedup     of each class of near copies (SimHash classes, verified and completed at a 5-word
               Jaccard of 0.8 or more) the smallest doc_id stays
secret_scan    documents that hold a secret go
mix            documents are repeated, kept or left out so that sources meet their targets
packing        the mix as token sequences

All stages but the last return the columns of their input, in its order. Each works on all
rows that its predecessor kept, and passes any further columns through, whatever their names.
A null doc_id is a document of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, mixing, packing, secrets
from tidemark.llm.common import checkpoint, table, whole

#: A document whose language is less probable than this is not kept.
SURE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no language: null, without a letter, or with a score under SURE."""
    found = langid.labelled(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= SURE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of the smallest doc_id of each class; null ids all stay. Classes are of texts:
    texts of different classes that share a doc_id do not remove each other."""
    rows = docs.select(whole(docs), "doc_id", jaccard.mark(F.col("text")).alias("mark"))
    named = rows.where("doc_id is not null")
    found = named.select("doc_id", "mark").join(jaccard.classes(docs.where("doc_id is not null")), "mark")
    least = found.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("least")).select("least.*")
    kept = named.join(least, ["mark", "doc_id"], "left_semi").dropDuplicates(["mark", "doc_id"])
    return kept.select("row.*").unionByName(rows.where("doc_id is null").select("row.*"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects every document, by blob, in which a rule of the ledger has a finding."""
    found = secrets.scan(docs, None, secrets.RULES + secrets.ADDED).known
    bad = found.where(F.size("spans") > 0).select("blob").distinct()
    rows = docs.select(whole(docs), secrets.blob(F.col("text")).alias("blob"))
    return rows.join(bad, "blob", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each use of a document; the one that a source's target cuts is cut. Rows
    stand by shard, in the order of their places: a partition is a run of one or more shards."""
    mixed = checkpoint(mixing.mix(docs.select("doc_id", "source", "text", whole(docs)), keep=("row",)).select("row", "size", "copies"))
    uses = mixed.select("row", "size", F.explode("copies").alias("use"))
    uses = uses.repartitionByRange("use.shard", "use.place").sortWithinPartitions("use.shard", "use.place")
    pieces = F.regexp_extract_all("row.text", F.lit(mixing.WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(pieces, F.lit(1), F.col("use.words").cast("int")), "")
    new = {"text": F.when(F.col("use.words") < F.col("size"), part).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return uses.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix", mix),
    ("packing", pack),
]

#: Networks, hashes and tokens have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
