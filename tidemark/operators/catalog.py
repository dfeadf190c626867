"""Names, files and remote listings as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import event_days, suffix

AGES = (0, 1, *range(5, 81, 5))


def files(listing: DataFrame, drop_suffixes: tuple[str, ...] = (), drop_names: tuple[str, ...] = ()) -> DataFrame:
    """Files without those of some types (scripts always) and names."""
    return listing.where(~suffix(F.col("name")).isin(*drop_suffixes, "py") & ~F.col("name").isin(*drop_names) if drop_names else ~suffix(F.col("name")).isin(*drop_suffixes, "py"))


def folders(listing: DataFrame, contains: tuple[str, ...] = ()) -> DataFrame:
    """Names without a dot that hold all of the given parts."""
    out = listing.where(F.instr("name", ".") == 0)
    for part in contains:
        out = out.where(F.contains(F.col("name"), F.lit(part)))
    return out


def matching(listing: DataFrame, suffixes: tuple[str, ...] = (), contains: tuple[str, ...] = ()) -> DataFrame:
    """Files with any of the suffixes and all of the parts."""
    out = listing.where(suffix(F.col("name")).isin(*suffixes)) if suffixes else listing
    for part in contains:
        out = out.where(F.contains(F.col("name"), F.lit(part)))
    return out


def todo(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def periods(countries: DataFrame, archives: DataFrame) -> DataFrame:
    """Days and number of events of every country; 0 and 0 for one without."""
    sums = archives.groupBy("country").agg(F.sum(event_days(F.col("name"))).alias("days"), F.count("*").alias("times"))
    return countries.join(sums, "country", "left").select("country", F.coalesce("days", F.lit(0)).cast("long").alias("days"), F.coalesce("times", F.lit(0)).cast("long").alias("times"))


def population_names(countries: DataFrame, year: int = 2020) -> DataFrame:
    """File names by country, gender and age class."""
    genders = F.explode(F.array(F.lit("f"), F.lit("m"))).alias("gender")
    ages = F.explode(F.array(*[F.lit(a) for a in AGES])).alias("age")
    each = countries.select("country", genders).select("country", "gender", ages)
    return each.withColumn("name", F.format_string(f"%s_%s_%d_{year}_constrained_UNadj.tif", F.lower("country"), "gender", "age"))


def byte_ranges(sizes: DataFrame, step: int = 16 << 20) -> DataFrame:
    """(name, start, end) of the pieces of each file, ends included and never shared."""
    starts = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    each = sizes.select("name", "size", F.explode(starts).alias("start"))
    return each.select("name", "start", (F.least(F.col("start") + step, F.col("size")) - 1).alias("end"))


def archive_urls(listings: DataFrame, base: str) -> DataFrame:
    """(country, url) from JSON lists of paths whose fourth part names the archive."""
    paths = F.explode(F.from_json("body", "array<string>")).alias("path")
    return listings.select("country", paths).select("country", F.concat(F.lit(base), F.split("path", "/")[3], F.lit(".zip")).alias("url"))


def page_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, n, href) of every link of a page, in order."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(hrefs).alias("n", "href"))


def dedup_events(members: DataFrame) -> DataFrame:
    """Each archive member once: in the first country, by name, that has it."""
    return members.groupBy("member").agg(F.min("country").alias("country"))


def countries(spark: SparkSession, path: str) -> DataFrame:
    """The country dimension from a CSV with header id, name."""
    return spark.read.schema("id string, name string").option("header", True).csv(path)


def population_ids(listings: DataFrame, body: str = "body") -> DataFrame:
    """(country, id) from JSON lists of the population catalogue; the first entry of a country counts."""
    each = listings.select(F.posexplode(F.from_json(body, "array<struct<id:string,country:string>>")).alias("n", "e"))
    return each.groupBy("e.country").agg(F.min_by("e.id", "n").alias("id"))


def with_ids(names: DataFrame, known: DataFrame, name: str = "country") -> DataFrame:
    """Names with the id of the name itself or, without one, of what stands before its first
    comma; null where neither is known."""
    short = F.trim(F.element_at(F.split(name, ","), 1))
    one = known.select(F.col(name).alias("k"), F.col("id").alias("own"))
    other = known.select(F.col(name).alias("s"), F.col("id").alias("second"))
    found = names.join(one, F.col(name) == F.col("k"), "left").join(other, short == F.col("s"), "left")
    return found.select(*names.columns, F.coalesce("own", "second").alias("id"))
