"""Registered queries on the driver tables and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.geodesic import geodesic_length
from tidemark.functions.lineage import checkpoint, folder
from tidemark.operators import catalog, graph, nearest, raster, update
from tidemark.plans.fixtures import load, oracle, unnumbered
from tidemark.sources import readers
from tidemark.sources.progress import Progress
from tidemark.streaming.incremental import process_new

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

D0 = 30


class Tables:
    """Fixtures of one call by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def links(self) -> DataFrame:
        """fx_edges without the numbers."""
        return unnumbered(self.spark, self.sf_dir, "fx_edges")

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


def query(sql: str | None = None, *names: str, recursive: bool = False):
    """Registers a function of the tables, with the SQL it equals."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = oracle(sql, *names, recursive=recursive) if names else sql
        return fn

    return register


# --- nearest neighbours ----------------------------------------------------

_NEAREST = """n AS (SELECT p.fid, n.fid AS node, (p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y) AS d2,
  ROW_NUMBER() OVER (PARTITION BY p.fid ORDER BY (p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y), n.fid) AS k FROM fx_points p, fx_nodes n)"""
_EVCS = f"""{_NEAREST}, e AS (SELECT node, COUNT(*) AS evcs_num, string_agg(fid, ',' ORDER BY fid) AS evcs_fids FROM n WHERE k=1 GROUP BY node)"""


@query(f"WITH {_NEAREST} SELECT fid, node, d2 FROM n WHERE k=1", "fx_points", "fx_nodes")
def nearest_node(t: Tables) -> DataFrame:
    return nearest.nearest(t.fx_points, t.fx_nodes)


def _evcs(t: Tables) -> DataFrame:
    return nearest.count_and_list(nearest.nearest(t.fx_points, t.fx_nodes)).withColumnRenamed("node", "fid")


@query(f"WITH {_EVCS} SELECT x.fid, evcs_num, evcs_fids FROM fx_nodes x LEFT JOIN e ON e.node=x.fid", "fx_points", "fx_nodes")
def evcs_per_node(t: Tables) -> DataFrame:
    nodes = update.add_fields(t.fx_nodes.select("fid"), {"evcs_num": ("bigint", None), "evcs_fids": ("array<bigint>", None)})
    linked = update.fill_null(nodes, _evcs(t), "fid", ["evcs_num", "evcs_fids"], "evcs_num")
    return linked.select("fid", "evcs_num", F.array_join("evcs_fids", ",").alias("evcs_fids"))


# --- reach and access ------------------------------------------------------


def _reach_sql(where: str = "") -> str:
    return f"""p(src,node,d) AS (SELECT fid, fid, CAST(0 AS BIGINT) FROM fx_nodes
  UNION SELECT p.src, e.v, p.d+e.length FROM p JOIN fx_edges e ON e.u=p.node WHERE p.d+e.length<={D0} {where}),
 reach AS (SELECT src, node, MIN(d) AS d FROM p GROUP BY 1,2)"""


@query(f"WITH {_reach_sql()} SELECT src, node, d FROM reach", "fx_nodes", "fx_edges", recursive=True)
def bounded_reach(t: Tables) -> DataFrame:
    return graph.reach(t.fx_nodes, t.links, D0)


@query(f"WITH {_reach_sql()} SELECT src, node, d FROM reach", "fx_nodes", "fx_edges", recursive=True)
def bounded_reach_joined(t: Tables) -> DataFrame:
    return graph.reach(t.fx_nodes, t.links, D0, local_edges=0)


def _access_sql(after: bool, tag: str = "") -> str:
    hit = "(SELECT COUNT(*) FROM n JOIN fx_affected f USING (fid) WHERE k=1 AND n.node=e.node AND f.value<>0)" if after else "0"
    return f"""{_EVCS}, {_reach_sql("AND e.affectDays=0" if after else "")},
 s AS (SELECT node AS fid, evcs_num-{hit} AS num FROM e),
 q AS (SELECT src, node, exp(-0.5*pow(CAST(d AS DOUBLE)/{D0}.0,2)) AS f FROM reach JOIN s ON s.fid=src),
 tot AS (SELECT src, SUM(pop*f) AS total FROM q JOIN fx_nodes x ON x.fid=q.node WHERE pop<>0 GROUP BY 1),
 r AS (SELECT s.fid, CASE WHEN total>0 THEN num/total ELSE 0 END AS r FROM s LEFT JOIN tot ON tot.src=s.fid),
 acc AS (SELECT q.node AS fid, SUM(r*f) AS a FROM q JOIN r ON r.fid=q.src GROUP BY 1),
 res AS (SELECT x.fid, ROUND(r.r*1e6,3) AS r, ROUND(CASE WHEN pop<>0 THEN coalesce(a,0) END*1e6,3) AS a
         FROM fx_nodes x LEFT JOIN r ON r.fid=x.fid LEFT JOIN acc ON acc.fid=x.fid)"""


def _access(t: Tables, after: bool) -> DataFrame:
    nodes = t.fx_nodes.join(_evcs(t), "fid", "left")
    edges = t.links
    if after:
        nodes, edges = graph.flooded(nodes, edges, graph.hit_points(t.fx_affected))
    found = graph.access(nodes, edges, D0)
    return found.select("fid", F.round(F.col("r") * 1e6, 3).alias("r"), F.round(F.col("a") * 1e6, 3).alias("a"))


_ACCESS = ("fx_points", "fx_nodes", "fx_edges", "fx_affected")


@query(f"WITH {_access_sql(False)} SELECT fid, r, a FROM res", *_ACCESS, recursive=True)
def accessibility_2sfca(t: Tables) -> DataFrame:
    return _access(t, False)


@query(f"WITH {_access_sql(True)} SELECT fid, r, a FROM res", *_ACCESS, recursive=True)
def accessibility_after_flood(t: Tables) -> DataFrame:
    return _access(t, True)


@query(
    f"""SELECT b.fid, b.a AS before, a.a AS after, ROUND(a.a-b.a,3) AS change
 FROM ({ORACLES["accessibility_2sfca"]}) b JOIN ({ORACLES["accessibility_after_flood"]}) a USING (fid)"""
)
def accessibility_delta(t: Tables) -> DataFrame:
    before, after = _access(t, False), _access(t, True)
    both = before.select("fid", F.col("a").alias("before")).join(after.select("fid", F.col("a").alias("after")), "fid")
    return both.select("fid", "before", "after", F.round(F.col("after") - F.col("before"), 3).alias("change"))


@query(
    """SELECT fid, CAST(COUNT(*) AS BIGINT) AS links, CAST(SUM(CASE WHEN affectDays=0 THEN 1 ELSE 0 END) AS BIGINT) AS open
       FROM (SELECT u AS fid, affectDays FROM fx_edges) GROUP BY fid""",
    "fx_edges",
)
def open_links(t: Tables) -> DataFrame:
    return t.fx_edges.groupBy(F.col("u").alias("fid")).agg(F.count("*").alias("links"), F.sum((F.col("affectDays") == 0).cast("long")).alias("open"))


# --- rasters ---------------------------------------------------------------


@query("SELECT event, r, c, CASE WHEN perm<>0 THEN 0 ELSE days END AS days FROM fx_flood WHERE perm=0 AND days<>0", "fx_flood")
def flood_mask(t: Tables) -> DataFrame:
    masked = raster.mask(t.fx_flood, "days", "perm")
    return masked.where(raster.valid(F.col("days"))).select("event", "r", "c", "days")


@query("SELECT r, c, CAST(SUM(days*(1-perm)) AS BIGINT) AS days FROM fx_flood GROUP BY r, c", "fx_flood")
def flood_sum_days(t: Tables) -> DataFrame:
    return raster.sum_cells(raster.mask(t.fx_flood, "days", "perm"), ["r", "c"], "days")


@query(
    """, c AS (SELECT DISTINCT 'N' || n_nationkey AS country FROM nation UNION SELECT 'none'),
 a AS (SELECT country, SUM(date_diff('day', strptime(split_part(name,'_',4),'%Y%m%d'), strptime(left(split_part(name,'_',6),8),'%Y%m%d'))+1) AS days, COUNT(*) AS times FROM fx_archives GROUP BY 1)
SELECT country, CAST(coalesce(days,0) AS BIGINT) AS days, CAST(coalesce(times,0) AS BIGINT) AS times FROM c LEFT JOIN a USING (country)""",
    "fx_archives",
)
def flood_period(t: Tables) -> DataFrame:
    names = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("country")).unionByName(t.spark.createDataFrame([("none",)], "country string"))
    return catalog.periods(names.distinct(), t.fx_archives)


_CLEAN = "CASE WHEN val=-99999 THEN 0 ELSE val END"


@query(f"SELECT r, c, CAST(SUM({_CLEAN}) AS BIGINT) AS val FROM fx_pop GROUP BY r, c", "fx_pop")
def population_merge(t: Tables) -> DataFrame:
    return raster.sum_cells(t.fx_pop, ["r", "c"], "val", raster.NODATA)


@query(f"SELECT gender, r, c, CAST(SUM({_CLEAN}) AS BIGINT) AS val FROM fx_pop GROUP BY gender, r, c", "fx_pop")
def population_by_gender(t: Tables) -> DataFrame:
    return raster.sum_cells(t.fx_pop, ["gender", "r", "c"], "val", raster.NODATA)


_GROUP = "CASE WHEN age BETWEEN 0 AND 20 THEN 'children' WHEN age BETWEEN 25 AND 40 THEN 'young' WHEN age BETWEEN 45 AND 55 THEN 'middle' WHEN age BETWEEN 60 AND 80 THEN 'elderly' END"


@query(f"SELECT {_GROUP} AS age_group, r, c, CAST(SUM({_CLEAN}) AS BIGINT) AS val FROM fx_pop WHERE {_GROUP} IS NOT NULL GROUP BY 1, 2, 3", "fx_pop")
def population_by_age_group(t: Tables) -> DataFrame:
    cells = t.fx_pop.withColumn("age_group", raster.age_group(F.col("age"))).where("age_group is not null")
    return raster.sum_cells(cells, ["age_group", "r", "c"], "val", raster.NODATA)


@query(
    f"""SELECT r, c, gender, age, CASE WHEN GROUPING(gender)=1 AND GROUPING(age)=1 THEN 'all' WHEN GROUPING(age)=1 THEN 'gender' ELSE 'age' END AS by,
 CAST(SUM({_CLEAN}) AS BIGINT) AS val FROM fx_pop GROUP BY GROUPING SETS ((r,c),(r,c,gender),(r,c,age))""",
    "fx_pop",
)
def population_grouping_sets(t: Tables) -> DataFrame:
    by = F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "gender").otherwise("age")
    return raster.grouped_sums(t.fx_pop).select("r", "c", "gender", "age", by.alias("by"), "val")


@query(
    """, s AS (SELECT r, c, SUM(days*(1-perm)) AS days FROM fx_flood GROUP BY 1, 2)
SELECT fid, CAST(coalesce(days,0) AS BIGINT) AS days FROM fx_points LEFT JOIN s ON r=y AND c=x""",
    "fx_points",
    "fx_flood",
)
def pixel_sample(t: Tables) -> DataFrame:
    return raster.sample(t.fx_points, flood_sum_days(t), "days")


def _pixels(t: Tables) -> DataFrame:
    """Cells of the population grid as points, with centres at whole numbers."""
    return t.fx_pop.select("r", "c").distinct().select((F.col("r") * 101 + F.col("c")).alias("fid"), F.col("c").alias("x"), F.col("r").alias("y"))


_PIXEL = """, px AS (SELECT DISTINCT r, c FROM fx_pop), m AS (SELECT px.r, px.c, n.fid, (px.c-n.x)*(px.c-n.x)+(px.r-n.y)*(px.r-n.y) AS d2,
  ROW_NUMBER() OVER (PARTITION BY px.r, px.c ORDER BY (px.c-n.x)*(px.c-n.x)+(px.r-n.y)*(px.r-n.y), n.fid) AS k FROM px, fx_nodes n),
 tot AS (SELECT m.fid, SUM(val) AS total FROM fx_pop p JOIN m ON m.r=p.r AND m.c=p.c AND k=1 {where} WHERE val<>-99999 GROUP BY 1)
SELECT x.fid, CAST(coalesce(total,0) AS BIGINT) AS total FROM fx_nodes x LEFT JOIN tot USING (fid)"""


def _pixel_sums(t: Tables, limit: float | None) -> DataFrame:
    met = nearest.nearest(_pixels(t), t.fx_nodes, limit)
    cells = met.select(F.floor(F.col("fid") / 101).alias("r"), (F.col("fid") % 101).alias("c"), "node")
    return raster.pixel_sums(t.fx_pop, cells, t.fx_nodes, "val")


@query(_PIXEL.format(where=""), "fx_pop", "fx_nodes")
def pixel_sum_per_node(t: Tables) -> DataFrame:
    return _pixel_sums(t, None)


@query(_PIXEL.format(where="AND d2<=9"), "fx_pop", "fx_nodes")
def pixel_sum_within_distance(t: Tables) -> DataFrame:
    return _pixel_sums(t, 3.0)


@query("SELECT event, r, c, days FROM fx_flood WHERE r BETWEEN 10 AND 20 AND c BETWEEN 30 AND 45", "fx_flood")
def raster_clip(t: Tables) -> DataFrame:
    return raster.clip(t.fx_flood.select("event", "r", "c", "days"), (30.0, 10.0, 45.5, 20.5))


# --- rasters under lines ---------------------------------------------------

_LINES = """, g AS (SELECT fid, unnest(range(0, CAST(greatest(abs(c1-c0), abs(r1-r0)) AS BIGINT)+1)) AS i, c0, r0, sign(c1-c0) AS sc, sign(r1-r0) AS sr FROM fx_lines),
 lc AS (SELECT DISTINCT fid, r0+i*sr AS r, c0+i*sc AS c FROM g),
 mk AS (SELECT event, r, c, days*(1-perm) AS days FROM fx_flood)"""


@query(_LINES + " SELECT l.fid, CAST(coalesce(MAX(days),0) AS INT) AS days FROM fx_lines l LEFT JOIN lc USING (fid) LEFT JOIN mk USING (r, c) GROUP BY l.fid", "fx_lines", "fx_flood")
def road_max_flood(t: Tables) -> DataFrame:
    return raster.zonal_max(t.fx_lines, raster.mask(t.fx_flood, "days", "perm"), "days")


@query(_LINES + " SELECT fid, event, MAX(days) AS days FROM lc JOIN mk USING (r, c) GROUP BY fid, event", "fx_lines", "fx_flood")
def road_max_flood_by_event(t: Tables) -> DataFrame:
    return raster.zonal_max(t.fx_lines, raster.mask(t.fx_flood, "days", "perm").drop("perm"), "days", ["event"])


@query(_LINES + ", e AS (SELECT fid, event, MAX(days) AS days FROM lc JOIN mk USING (r, c) WHERE days<>0 GROUP BY fid, event) SELECT fid, arg_max(event, days*100+event) AS event, MAX(days) AS days FROM e GROUP BY fid", "fx_lines", "fx_flood")
def road_worst_event(t: Tables) -> DataFrame:
    return raster.worst(road_max_flood_by_event(t), "fid", "event", "days")


@query("SELECT event FROM fx_flood GROUP BY event HAVING MAX(days*(1-perm))>0", "fx_flood")
def nonzero_events(t: Tables) -> DataFrame:
    return raster.mask(t.fx_flood, "days", "perm").groupBy("event").agg(F.max("days").alias("top")).where("top > 0").select("event")


@query("SELECT event, list_sort(list(DISTINCT days)) AS days FROM fx_flood WHERE perm=0 GROUP BY event", "fx_flood")
def distinct_cell_values(t: Tables) -> DataFrame:
    return t.fx_flood.where("perm = 0").groupBy("event").agg(F.sort_array(F.collect_set("days")).alias("days"))


# --- updates ---------------------------------------------------------------

_TARGET = "tg AS (SELECT fid, CASE WHEN fid%3=0 THEN NULL ELSE pop END AS pop FROM fx_nodes), up AS (SELECT fid, fid*10 AS pop FROM fx_nodes WHERE fid%2=0)"


def _target(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.fx_nodes.select("fid", F.when(F.col("fid") % 3 != 0, F.col("pop")).alias("pop")), t.fx_nodes.where("fid % 2 = 0").select("fid", (F.col("fid") * 10).alias("pop"))


@query(f"WITH {_TARGET} SELECT tg.fid, CASE WHEN up.fid IS NOT NULL THEN up.pop ELSE tg.pop END AS pop FROM tg LEFT JOIN up USING (fid)", "fx_nodes")
def edge_update_from(t: Tables) -> DataFrame:
    return update.update_from(*_target(t), "fid", ["pop"])


@query(f"WITH {_TARGET} SELECT tg.fid, up.pop FROM tg LEFT JOIN up USING (fid)", "fx_nodes")
def update_overwrite_null(t: Tables) -> DataFrame:
    return update.overwrite(*_target(t), "fid", ["pop"])


@query(f"WITH {_TARGET} SELECT tg.fid, CASE WHEN tg.pop IS NULL THEN up.pop ELSE tg.pop END AS pop FROM tg LEFT JOIN up USING (fid)", "fx_nodes")
def update_fill_null(t: Tables) -> DataFrame:
    return update.fill_null(*_target(t), "fid", ["pop"], "pop")


@query(f"WITH {_TARGET} SELECT tg.fid, coalesce(tg.pop, up.pop) AS pop FROM tg LEFT JOIN up USING (fid)", "fx_nodes")
def update_fill_null_in(t: Tables) -> DataFrame:
    return update.fill_null_in(*_target(t), "fid", "pop")


@query("SELECT fid, x, y, pop, CAST(7 AS BIGINT) AS rank, CAST(NULL AS DOUBLE) AS score FROM fx_nodes", "fx_nodes")
def add_fields_default(t: Tables) -> DataFrame:
    return update.add_fields(t.fx_nodes, {"pop": ("bigint", 0), "rank": ("bigint", 7), "score": ("double", None)})


@query("SELECT fid, pop FROM fx_nodes", "fx_nodes")
def drop_fields(t: Tables) -> DataFrame:
    return update.drop_fields(t.fx_nodes, "x", "y", "not_there")


# --- names, files, listings ------------------------------------------------


@query("SELECT name FROM fx_archives WHERE name NOT IN (SELECT name FROM fx_archives WHERE country IN ('N1','N2'))", "fx_archives")
def anti_processed(t: Tables) -> DataFrame:
    a = t.fx_archives
    return catalog.todo(a.select("name"), a.where(F.col("country").isin("N1", "N2")), "name")


@query("SELECT 'N' || (n_nationkey+5) AS country FROM nation EXCEPT SELECT country FROM fx_archives", "fx_archives")
def missing_countries(t: Tables) -> DataFrame:
    return t.nation.select(F.concat(F.lit("N"), (F.col("n_nationkey") + 5).cast("string")).alias("country")).exceptAll(t.fx_archives.select("country")).distinct()


@query("SELECT name FROM fx_archives WHERE right(name,4)='.zip' AND contains(name,'_199') AND contains(name,'DFO')", "fx_archives")
def file_filter(t: Tables) -> DataFrame:
    return catalog.matching(t.fx_archives, ("zip", "tif"), ("_199", "DFO")).select("name")


@query("""SELECT DISTINCT country, g.gender, CAST(a.age AS INT) AS age, lower(country) || '_' || g.gender || '_' || a.age || '_2020_constrained_UNadj.tif' AS name
 FROM fx_archives, (VALUES ('f'),('m')) g(gender), (SELECT 0 AS age UNION SELECT 1 UNION SELECT unnest(range(5,81,5))) a""", "fx_archives")
def name_generator(t: Tables) -> DataFrame:
    return catalog.population_names(t.fx_archives.select("country").distinct())


@query("""SELECT name, s AS start, least(s+1000, size)-1 AS "end" FROM (SELECT CAST(p_partkey AS STRING) AS name, CAST(p_size*100 AS BIGINT) AS size, unnest(range(0, CAST(p_size*100 AS BIGINT), 1000)) AS s FROM part)""")
def range_split(t: Tables) -> DataFrame:
    sizes = t.part.select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") * 100).cast("long").alias("size"))
    return catalog.byte_ranges(sizes, 1000)


@query("SELECT country, 'https://host/' || replace(name, '.zip', '') || '.zip' AS url FROM fx_archives", "fx_archives")
def catalog_json(t: Tables) -> DataFrame:
    path = F.concat(F.lit("a/b/c/"), F.regexp_replace("name", r"\.zip$", ""))
    bodies = t.fx_archives.groupBy("country").agg(F.to_json(F.collect_list(path)).alias("body"))
    return catalog.archive_urls(bodies, "https://host/")


@query("""SELECT page_id, n-1 AS n, h AS href FROM (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS hs FROM pages))""")
def page_links(t: Tables) -> DataFrame:
    return catalog.page_links(t.pages, "page_id").withColumn("n", F.col("n").cast("long"))


@query("SELECT name AS member, MIN(country) AS country FROM fx_archives GROUP BY name", "fx_archives")
def dedup_events(t: Tables) -> DataFrame:
    return catalog.dedup_events(t.fx_archives.withColumnRenamed("name", "member"))


@query("SELECT o_custkey AS country, CAST(SUM(o_totalprice) AS DOUBLE)>1000 AS processed FROM orders GROUP BY 1")
def processed_flag(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("country")).agg((F.sum("o_totalprice") > 1000).alias("processed"))


# --- lines and topology ----------------------------------------------------


@query("""SELECT fid, regexp_extract(other_tags, '"oneway"=>"([^"]*)"', 1)='yes' AS oneway, nullif(regexp_extract(other_tags, '"lanes"=>"([^"]*)"', 1), '') AS lanes FROM fx_lines""", "fx_lines")
def osm_tag_extract(t: Tables) -> DataFrame:
    return graph.with_tags(t.fx_lines).select("fid", "oneway", "lanes")


HIGHWAYS = ("motorway", "trunk", "primary", "secondary", "motorway_link", "trunk_link", "primary_link", "secondary_link")


@query("SELECT fid, highway FROM fx_lines WHERE highway IN ('motorway','trunk','primary','secondary','motorway_link','trunk_link','primary_link','secondary_link')", "fx_lines")
def highway_filter(t: Tables) -> DataFrame:
    return t.fx_lines.where(F.col("highway").isin(*HIGHWAYS)).select("fid", "highway")


@query("SELECT fid, highway FROM fx_lines WHERE regexp_matches(highway, '^motorway$|^trunk$')", "fx_lines")
def highway_regex(t: Tables) -> DataFrame:
    return t.fx_lines.where(F.col("highway").rlike("^motorway$|^trunk$")).select("fid", "highway")


def _lines(t: Tables) -> DataFrame:
    """Each line with a middle vertex, as coordinates."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    mid = p((F.col("c0") + F.col("c1")) / 2, (F.col("r0") + F.col("r1")) / 2)
    coords = F.array(p(F.col("c0"), F.col("r0")), mid, p(F.col("c1"), F.col("r1")))
    return graph.with_tags(t.fx_lines).withColumn("coords", coords).select("fid", "coords", "oneway")


_BOTH = """, ow AS (SELECT *, regexp_extract(other_tags, '"oneway"=>"([^"]*)"', 1)='yes' AS oneway FROM fx_lines),
 dir AS (SELECT fid, CAST(c0 AS DOUBLE) AS ux, CAST(r0 AS DOUBLE) AS uy, CAST(c1 AS DOUBLE) AS vx, CAST(r1 AS DOUBLE) AS vy, false AS reversed FROM ow
  UNION ALL SELECT fid, c1, r1, c0, r0, true FROM ow WHERE NOT oneway)"""


@query(_BOTH + " SELECT * FROM dir", "fx_lines")
def line_explode_reverse(t: Tables) -> DataFrame:
    _, edges = graph.topology(_lines(t))
    return edges.select(F.col("line").alias("fid"), F.col("coords")[0]["x"].alias("ux"), F.col("coords")[0]["y"].alias("uy"), F.element_at("coords", -1)["x"].alias("vx"), F.element_at("coords", -1)["y"].alias("vy"), "reversed")


@query(
    _BOTH
    + """, nd AS (SELECT x, y, ROW_NUMBER() OVER (ORDER BY x, y) AS fid FROM (SELECT ux AS x, uy AS y FROM dir UNION SELECT vx, vy FROM dir))
SELECT d.fid AS line, a.fid AS u, b.fid AS v, d.reversed, CAST(ROW_NUMBER() OVER (PARTITION BY a.fid, b.fid ORDER BY d.fid, d.reversed)-1 AS INT) AS key
FROM dir d JOIN nd a ON a.x=ux AND a.y=uy JOIN nd b ON b.x=vx AND b.y=vy""",
    "fx_lines",
)
def graph_topology(t: Tables) -> DataFrame:
    _, edges = graph.topology(_lines(t))
    return edges.select("line", "u", "v", "reversed", "key")


@query(
    """, ln AS (SELECT fid, c0, r0, c1, r1, greatest(abs(c1-c0), abs(r1-r0)) AS n, sign(c1-c0) AS sc, sign(r1-r0) AS sr FROM fx_lines WHERE c0<>c1 OR r0<>r1),
 st AS (SELECT fid, unnest(range(1, CAST(n AS BIGINT))) AS i, c0, r0, sc, sr FROM ln),
 ct AS (SELECT st.fid, i, min(x.fid) AS node FROM st JOIN fx_nodes x ON x.x=c0+i*sc AND x.y=r0+i*sr GROUP BY 1, 2),
 al AS (SELECT fid, i, node FROM ct UNION ALL SELECT fid, 0, -1 FROM ln UNION ALL SELECT fid, CAST(n AS BIGINT), -2 FROM ln),
 pr AS (SELECT fid, ROW_NUMBER() OVER w - 1 AS piece, node AS u, LEAD(node) OVER w AS v, i, LEAD(i) OVER w AS j FROM al WINDOW w AS (PARTITION BY fid ORDER BY i, node))
SELECT pr.fid, CAST(piece AS INT) AS piece, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, ROUND((j-i)*sqrt(sc*sc+sr*sr), 6) AS length FROM pr JOIN ln USING (fid) WHERE v IS NOT NULL""",
    "fx_lines",
    "fx_nodes",
)
def edge_split(t: Tables) -> DataFrame:
    places = t.fx_nodes.groupBy("x", "y").agg(F.min("fid").alias("fid"))
    edges = _lines(t).where(F.col("coords")[0] != F.element_at("coords", -1)).select("fid", F.lit(-1).cast("long").alias("u"), F.lit(-2).cast("long").alias("v"), "coords")
    cut = graph.split_edges(edges, places, cell=4.0)
    return cut.select("fid", "piece", "u", "v", F.round(graph.planar_length(F.col("coords")), 6).alias("length"))


@query(
    """WITH lk AS (SELECT a.fid AS a, b.fid AS b FROM fx_nodes a JOIN fx_nodes b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=64),
 cc(fid, other) AS (SELECT fid, fid FROM fx_nodes UNION SELECT cc.fid, lk.b FROM cc JOIN lk ON lk.a=cc.other),
 lb AS (SELECT fid, MIN(other) AS label FROM cc GROUP BY 1)
SELECT label AS fid, ROUND(AVG(x),6) AS x, ROUND(AVG(y),6) AS y, COUNT(*) AS members FROM lb JOIN fx_nodes USING (fid) GROUP BY 1""",
    "fx_nodes",
    recursive=True,
)
def consolidate_nodes(t: Tables) -> DataFrame:
    merged, _ = graph.consolidate(t.fx_nodes, t.fx_edges, 4.0)
    return merged.select("fid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "members")


@query(None)
def geodesic_lengths(t: Tables) -> DataFrame:
    xs = F.transform("coords", lambda p: p["x"])
    ys = F.transform("coords", lambda p: p["y"] - 45)
    return _lines(t).select("fid", F.round(geodesic_length(xs, ys), 3).alias("metres"))


@query("SELECT fid, ROUND(radians(CAST(x AS DOUBLE))*6378137.0, 3)+0.0 AS mx, ROUND(ln(tan(pi()/4+radians(CAST(y AS DOUBLE)-45)/2))*6378137.0, 3)+0.0 AS my FROM fx_nodes", "fx_nodes")
def reproject_points(t: Tables) -> DataFrame:
    x, y = C.reproject(F.col("x").cast("double"), F.col("y").cast("double") - 45, "EPSG:4326", "EPSG:3857")
    return t.fx_nodes.select("fid", (F.round(x, 3) + 0.0).alias("mx"), (F.round(y, 3) + 0.0).alias("my"))


@query("SELECT fid, CAST(node AS BIGINT) AS next, fid AS node FROM (SELECT fid, LEAD(fid) OVER (PARTITION BY y ORDER BY x, fid) AS node FROM fx_nodes)", "fx_nodes")
def consecutive_pairs(t: Tables) -> DataFrame:
    following = F.lead("fid").over(W.partitionBy("y").orderBy("x", "fid"))
    return t.fx_nodes.select("fid", following.alias("next"), F.col("fid").alias("node"))


# --- predicates ------------------------------------------------------------


@query("SELECT fid FROM fx_affected WHERE value<>0", "fx_affected")
def affected_points(t: Tables) -> DataFrame:
    return graph.hit_points(t.fx_affected)


@query("SELECT fid, u, v FROM fx_edges WHERE affectDays=0", "fx_edges")
def open_edges(t: Tables) -> DataFrame:
    return t.fx_edges.where(F.col("affectDays") == 0).select("fid", "u", "v")


@query("SELECT fid FROM (SELECT fid, CASE WHEN fid%3=0 THEN NULL ELSE pop END AS pop FROM fx_nodes) WHERE pop IS NULL", "fx_nodes")
def work_left(t: Tables) -> DataFrame:
    target, _ = _target(t)
    return target.where(F.col("pop").isNull()).select("fid")


@query("SELECT fid FROM fx_lines WHERE NOT (greatest(c0,c1)<20 OR least(c0,c1)>60 OR greatest(r0,r1)<10 OR least(r0,r1)>50)", "fx_lines")
def lines_in_box(t: Tables) -> DataFrame:
    boxed = t.fx_lines.select("fid", F.least("c0", "c1").alias("a_x0"), F.greatest("c0", "c1").alias("a_x1"), F.least("r0", "r1").alias("a_y0"), F.greatest("r0", "r1").alias("a_y1"))
    boxed = boxed.withColumns({"b_x0": F.lit(20), "b_x1": F.lit(60), "b_y0": F.lit(10), "b_y1": F.lit(50)})
    return boxed.where(~raster.disjoint("a", "b")).select("fid")


@query(
    """, f AS (SELECT country || '_' || g.gender || '_' || CAST(a.age AS VARCHAR) || '_2020_constrained_UNadj.tif' AS name
  FROM (SELECT DISTINCT lower(country) AS country FROM fx_archives), (VALUES ('f'),('m')) g(gender), (SELECT 0 AS age UNION SELECT 1 UNION SELECT unnest(range(5,81,5))) a)
SELECT name FROM f WHERE split_part(name,'_',2)='f' AND CAST(split_part(name,'_',3) AS INT) IN (0,1,5)""",
    "fx_archives",
)
def population_files(t: Tables) -> DataFrame:
    names = catalog.population_names(t.fx_archives.select("country").distinct()).select("name")
    gender, age = C.name_part(F.col("name"), "_", 1), C.name_part(F.col("name"), "_", 2).cast("int")
    return names.where(gender.isin("f") & age.isin(0, 1, 5))


@query("SELECT n_name AS name, 'N' || n_nationkey AS iso3, coalesce(times, 0) AS times FROM nation LEFT JOIN (SELECT country, COUNT(*) AS times FROM fx_archives GROUP BY 1) ON country='N' || n_nationkey WHERE n_name NOT IN ('CHINA','PERU')", "fx_archives")
def country_lookup(t: Tables) -> DataFrame:
    dim = t.nation.where(~F.col("n_name").isin("CHINA", "PERU")).select(F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("iso3"))
    counts = t.fx_archives.groupBy(F.col("country").alias("iso3")).agg(F.count("*").alias("times"))
    return dim.join(counts, "iso3", "left").select("name", "iso3", F.coalesce("times", F.lit(0)).cast("long").alias("times"))


@query("SELECT l.fid, CAST(n.parts AS BIGINT) AS cells FROM fx_lines l JOIN (SELECT fid, greatest(abs(c1-c0), abs(r1-r0))+1 AS parts FROM fx_lines) n USING (fid)", "fx_lines")
def line_cell_counts(t: Tables) -> DataFrame:
    return raster.line_cells(t.fx_lines, "fid").groupBy("fid").agg(F.count("*").alias("cells"))


# --- countries, odd values, repeated keys ----------------------------------


@query("WITH n AS (SELECT p.fid, n.fid AS node, (p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y) AS d2, ROW_NUMBER() OVER (PARTITION BY p.fid ORDER BY (p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y), n.fid) AS k FROM fx_points p JOIN fx_nodes n ON p.fid%3=n.fid%3) SELECT p.fid, p.fid%3 AS country, CASE WHEN p.fid%10<>0 THEN node END AS node, CASE WHEN p.fid%10<>0 THEN d2 END AS d2 FROM fx_points p LEFT JOIN n ON n.fid=p.fid AND k=1", "fx_points", "fx_nodes")
def nearest_node_in_country(t: Tables) -> DataFrame:
    """Points and nodes of three countries; some points have no place."""
    points = t.fx_points.select("fid", (F.col("fid") % 3).alias("country"), F.when(F.col("fid") % 10 != 0, F.col("x")).alias("x"), "y")
    return nearest.nearest(points, t.fx_nodes.withColumn("country", F.col("fid") % 3), keys=["country"])


@query("WITH tg AS (SELECT fid, pop FROM fx_nodes), up AS (SELECT fid, fid*10+1 AS pop FROM fx_nodes WHERE fid%2=0 UNION ALL SELECT fid, fid*10 FROM fx_nodes WHERE fid%4=0) SELECT fid, coalesce(m, pop) AS pop FROM tg LEFT JOIN (SELECT fid, MIN(pop) AS m FROM up GROUP BY 1) USING (fid)", "fx_nodes")
def update_repeated_keys(t: Tables) -> DataFrame:
    n = t.fx_nodes
    updates = n.where("fid % 2 = 0").select("fid", (F.col("fid") * 10 + 1).alias("pop")).unionByName(n.where("fid % 4 = 0").select("fid", (F.col("fid") * 10).alias("pop")))
    return update.update_from(n.select("fid", "pop"), updates, "fid", ["pop"])


#: Roads of two parts with oblique pieces, in coordinates; their country is a key.
_ROAD = ("c0+0.25", "r0+0.5", "c0+fid%9+0.75", "r0+fid%7+0.125", "c1+0.625", "r1+0.875", "c1+0.5", "r1+0.5", "c1+0.5-fid%11", "r1+0.5+fid%13")
_PIECES = ((0, 1, 2, 3), (2, 3, 4, 5), (6, 7, 8, 9))
_SEG = " UNION ALL ".join(f"SELECT fid, fid%3 AS country, CAST(floor({_ROAD[a]}) AS BIGINT) AS c0, CAST(floor(97-({_ROAD[b]})) AS BIGINT) AS r0, CAST(floor({_ROAD[c]}) AS BIGINT) AS c1, CAST(floor(97-({_ROAD[d]})) AS BIGINT) AS r1 FROM fx_lines" for a, b, c, d in _PIECES)
_ROADS = f""", sg AS ({_SEG}), sn AS (SELECT *, greatest(abs(c1-c0), abs(r1-r0)) AS n FROM sg),
 si AS (SELECT *, unnest(range(0, n+1)) AS i FROM sn),
 rc AS (SELECT DISTINCT fid, country, c0+CASE WHEN n=0 THEN 0 ELSE sign(c1-c0)*((2*i*abs(c1-c0)+n)//(2*n)) END AS c, r0+CASE WHEN n=0 THEN 0 ELSE sign(r1-r0)*((2*i*abs(r1-r0)+n)//(2*n)) END AS r FROM si),
 mk AS (SELECT event, event%3 AS country, r, c, CASE WHEN days%7=0 AND perm=0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(days*(1-perm) AS DOUBLE) END AS days FROM fx_flood)"""


def _roads(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roads, the cells under them, and flood cells of three countries, some not a number."""
    p = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    parts = F.array(F.array(*[p(*_ROAD[k : k + 2]) for k in (0, 2, 4)]), F.array(*[p(*_ROAD[k : k + 2]) for k in (6, 8)]))
    roads = t.fx_lines.select("fid", (F.col("fid") % 3).alias("country"), parts.alias("parts"))
    flood = raster.mask(t.fx_flood, "days", "perm").select("event", (F.col("event") % 3).alias("country"), "r", "c", F.when(F.expr("days % 7 = 0 and perm = 0"), float("nan")).otherwise(F.col("days").cast("double")).alias("days"))
    return roads, raster.polyline_cells(roads, (0.0, 1.0, 97.0, -1.0), "country", "fid"), flood


@query(_ROADS + " SELECT country, fid, coalesce(MAX(days) FILTER (WHERE NOT isnan(days)), 0) AS days FROM rc LEFT JOIN mk USING (country, r, c) GROUP BY 1, 2", "fx_lines", "fx_flood")
def road_max_flood_in_country(t: Tables) -> DataFrame:
    roads, under, flood = _roads(t)
    return raster.zonal_max(roads, flood, "days", keys=["country"], under=under)


@query(_ROADS + " SELECT country, fid, event, MAX(days) AS days FROM rc JOIN mk USING (country, r, c) WHERE NOT isnan(days) GROUP BY 1, 2, 3", "fx_lines", "fx_flood")
def road_max_flood_by_event_in_country(t: Tables) -> DataFrame:
    roads, under, flood = _roads(t)
    return raster.zonal_max(roads, flood, "days", ["event"], ["country"], under)


@query(
    f"""SELECT n.fid, n.pop, b.r AS "R_noFlooding", b.a AS "A_noFlooding", a.r AS "R_afterFlooding", a.a AS "A_afterFlooding"
 FROM ({oracle("SELECT fid, pop FROM fx_nodes", "fx_nodes")}) n JOIN ({ORACLES["accessibility_2sfca"]}) b USING (fid) JOIN ({ORACLES["accessibility_after_flood"]}) a USING (fid)"""
)
def accessibility_written_back(t: Tables) -> DataFrame:
    out = t.fx_nodes.select("fid", "pop")
    for run, after in zip(graph.RUNS, (False, True), strict=True):
        out = graph.write_back(out, _access(t, after), run)
    return out


# --- formats ---------------------------------------------------------------

_GRID = (10.0, 0.5, 50.0, -0.25)


def _tiles(t: Tables) -> DataFrame:
    return readers.raster_files(t.fx_flood.withColumnRenamed("perm", "water"), ["event"], ["days", "water"], _GRID, 32, -1.0)


@query("SELECT event, r, c, CAST(days AS DOUBLE) AS days, CAST(perm AS DOUBLE) AS water FROM fx_flood", "fx_flood")
def raster_files_round_trip(t: Tables) -> DataFrame:
    """Cells as GeoTIFF tiles of two bands, and their cells again."""
    return readers.tile_cells(_tiles(t), ["event"], ["days", "water"], 32)


@query(
    """, tl AS (SELECT DISTINCT event, CAST(r//32 AS BIGINT) AS tr, CAST(c//32 AS BIGINT) AS tc FROM fx_flood)
SELECT event, tr, tc, 32 AS width, 32 AS height, 2 AS bands, 'float32' AS dtype, 'EPSG:4326' AS crs, CAST(10+0.5*32*tc AS DOUBLE) AS "left", CAST(50-0.25*32*(tr+1) AS DOUBLE) AS bottom, CAST(10+0.5*32*(tc+1) AS DOUBLE) AS "right", CAST(50-0.25*32*tr AS DOUBLE) AS top FROM tl""",
    "fx_flood",
)
def raster_metadata(t: Tables) -> DataFrame:
    files = _tiles(t)
    found = readers.with_meta(files.select("event", "tr", "tc", "path"), readers.raster_meta(files))
    ends = (F.col("x0") + F.col("dx") * F.col("width")).alias("right"), (F.col("y0") + F.col("dy") * F.col("height")).alias("bottom")
    return found.select("event", "tr", "tc", "width", "height", "bands", "dtype", "crs", F.col("x0").alias("left"), F.col("y0").alias("top"), *ends)


@query("SELECT event, r, c, CAST(10+(c+0.5)*0.5 AS DOUBLE) AS x, CAST(50-(r+0.5)*0.25 AS DOUBLE) AS y FROM fx_flood", "fx_flood")
def cell_centres(t: Tables) -> DataFrame:
    return t.fx_flood.select("event", "r", "c", C.cell_centre(F.col("c"), *_GRID[:2]).alias("x"), C.cell_centre(F.col("r"), *_GRID[2:]).alias("y"))


@query("SELECT 'C' || fid%3 AS country, ROW_NUMBER() OVER (PARTITION BY fid%3 ORDER BY fid) AS fid, fid AS osmid, pop, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, 'EPSG:4326' AS crs FROM fx_nodes", "fx_nodes")
def geopackage_round_trip(t: Tables) -> DataFrame:
    """Graphs of three countries as files, and their node layers again."""
    country = F.concat(F.lit("C"), F.col("fid") % 3).alias("country")
    nodes = t.fx_nodes.select(country, F.col("fid").alias("osmid"), "pop", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    point = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y")))
    edges = t.fx_edges.select(F.concat(F.lit("C"), F.col("u") % 3).alias("country"), F.col("length").cast("double").alias("length"), point.alias("coords"))
    files = readers.geopackage_files(nodes, edges, {"osmid": "INTEGER", "pop": "INTEGER"}, {"length": "REAL"})
    files = checkpoint(files.select(F.concat_ws("/", "country", "part").alias("path"), "content"))
    layer = readers.vector_layer(files, {"osmid": "bigint", "pop": "bigint"}, "nodes")
    crs = readers.layer_info(files).where("layer = 'nodes'").select("path", "crs")
    order = W.partitionBy("country").orderBy("osmid")
    found = layer.join(crs, "path").withColumn("country", F.split("path", "/")[0])
    return found.select("country", F.row_number().over(order).cast("long").alias("fid"), "osmid", "pop", F.col("parts")[0][0]["x"].alias("x"), F.col("parts")[0][0]["y"].alias("y"), "crs")


@query("SELECT fid, highway, CAST(c0 AS DOUBLE) AS x0, CAST(r0 AS DOUBLE) AS y0, CAST(c1 AS DOUBLE) AS x1, CAST(r1 AS DOUBLE) AS y1, c0<>c1 OR r0<>r1 AS valid FROM fx_lines", "fx_lines")
def geojson_round_trip(t: Tables) -> DataFrame:
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    lines = t.fx_lines.select("fid", "highway", F.array(p("c0", "r0"), p("c1", "r1")).alias("coords"))
    found = readers.geojson(readers.features(lines, ["fid", "highway"]), {"fid": "bigint", "highway": "string"}).toDF("id", "fid", "highway", "parts")
    a, b = F.col("parts")[0][0], F.element_at(F.col("parts")[0], -1)
    return found.select("fid", "highway", a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"), C.valid_lines(F.col("parts")).alias("valid"))


@query("SELECT fid, CAST(value AS DOUBLE) AS value, value<>0 AS hit FROM fx_affected", "fx_affected")
def csv_round_trip(t: Tables) -> DataFrame:
    path = _scratch(t)
    readers.write_csv(t.fx_affected.select("fid", F.col("value").alias("values")), path)
    return readers.points_csv(t.spark, path).withColumn("hit", C.affected(F.col("value")))


@query("SELECT n_nationkey, n_name FROM nation")
def resumed_batches(t: Tables) -> DataFrame:
    """Files that arrive between two runs: each row is worked on once."""
    base = _scratch(t)
    nation = t.nation.select("n_nationkey", "n_name")
    for k in range(2):
        nation.where(F.col("n_nationkey") % 2 == k).write.mode("append").parquet(f"{base}/in")
        for _ in range(2):
            process_new(t.spark, f"{base}/in", nation.schema, lambda df: df, f"{base}/out", f"{base}/state")
    return t.spark.read.parquet(f"{base}/out").select("n_nationkey", "n_name")


@query("SELECT country AS key, name AS item FROM fx_archives WHERE country NOT IN ('N1','N2')", "fx_archives")
def progress_left(t: Tables) -> DataFrame:
    log = Progress(t.spark, _scratch(t), "download")
    wanted = t.fx_archives.select(F.col("country").alias("key"), F.col("name").alias("item"))
    log.append(wanted.where("key = 'N1'"))
    log.append(wanted.where("key in ('N1', 'N2')"))
    Progress(t.spark, log.path, "merge").append(wanted.where("key = 'N3'"))
    return log.todo(wanted)


def _scratch(t: Tables) -> str:
    return f"{folder(t.spark)}/tidemark-{uuid.uuid4().hex}"


# --- listings, ids, projections --------------------------------------------

_LISTING = "ls AS (SELECT CASE p_size%5 WHEN 0 THEN 'DFO_'||p_partkey||'.tif' WHEN 1 THEN 'run_'||p_partkey||'.py' WHEN 2 THEN 'DFO_'||p_partkey WHEN 3 THEN 'notes_'||p_partkey||'.aux.xml' ELSE 'N'||p_partkey END AS name FROM part)"


def _listing(t: Tables) -> DataFrame:
    key, kind = F.col("p_partkey").cast("string"), F.col("p_size") % 5
    name = F.when(kind == 0, F.concat(F.lit("DFO_"), key, F.lit(".tif"))).when(kind == 1, F.concat(F.lit("run_"), key, F.lit(".py"))).when(kind == 2, F.concat(F.lit("DFO_"), key)).when(kind == 3, F.concat(F.lit("notes_"), key, F.lit(".aux.xml"))).otherwise(F.concat(F.lit("N"), key))
    return t.part.select(name.alias("name"))


@query(f"WITH {_LISTING} SELECT name FROM ls WHERE NOT ends_with(name, '.xml') AND NOT ends_with(name, '.py') AND name <> 'N5'")
def listed_files(t: Tables) -> DataFrame:
    return catalog.files(_listing(t), ("xml",), ("N5",))


@query(f"WITH {_LISTING} SELECT name FROM ls WHERE NOT contains(name, '.') AND contains(name, 'DFO') AND contains(name, '1')")
def listed_folders(t: Tables) -> DataFrame:
    return catalog.folders(_listing(t), ("DFO", "1"))


@query("SELECT 'N' || c_custkey%40 AS country, CASE WHEN c_custkey%40<25 THEN CAST(c_custkey%40 AS VARCHAR) END AS id FROM customer")
def population_catalogue_ids(t: Tables) -> DataFrame:
    """Every fifth name has a comma, and is known by what stands before it."""
    entry = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("country"))
    listings = t.nation.groupBy("n_regionkey").agg(F.to_json(F.collect_list(entry)).alias("body"))
    short = F.concat(F.lit("N"), (F.col("c_custkey") % 40).cast("string"))
    names = t.customer.select(F.when(F.col("c_custkey") % 5 == 0, F.concat(short, F.lit(", Rep."))).otherwise(short).alias("country"))
    return catalog.with_ids(names, catalog.population_ids(listings)).select(F.split("country", ",")[0].alias("country"), "id")


@query("SELECT fid, x, y FROM fx_nodes WHERE fid IN (SELECT DISTINCT fid%50+1 FROM fx_points)", "fx_nodes", "fx_points")
def rows_by_fid(t: Tables) -> DataFrame:
    return update.lookup(t.fx_nodes.select("fid", "x", "y"), t.fx_points.select((F.col("fid") % 50 + 1).alias("fid")))


@query("SELECT country, list_sort(list(DISTINCT replace(o, '-', '_'))) AS days FROM (SELECT 'N' || o_custkey%25 AS country, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o FROM orders) GROUP BY 1")
def event_days_by_country(t: Tables) -> DataFrame:
    day = F.replace(F.col("o_orderdate").cast("date").cast("string"), F.lit("-"), F.lit("_"))
    return t.orders.groupBy(F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string")).alias("country")).agg(F.sort_array(F.collect_set(day)).alias("days"))


_UTM = ", ".join(f"{a!r} AS a{j}" for j, a in enumerate(C._TO, 1))


@query(
    f""", k AS (SELECT {_UTM}, {2 * C._N**0.5 / (1 + C._N)!r} AS e), g AS (SELECT fid, sin(radians(y*0.5)) AS s, radians(x*0.05-2.5) AS l, k.* FROM fx_nodes, k),
 h AS (SELECT *, sinh(atanh(s)-e*atanh(e*s)) AS t FROM g), z AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l)/sqrt(1+t*t)) AS eta FROM h)
SELECT fid, ROUND(500000+{C._MERIDIAN!r}*(eta+{"+".join(f"a{j}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j in range(1, 5))}), 3) AS east,
 ROUND({C._MERIDIAN!r}*(xi+{"+".join(f"a{j}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j in range(1, 5))}), 3)+0.0 AS north FROM z""",
    "fx_nodes",
)
def utm_points(t: Tables) -> DataFrame:
    """Nodes as places west and east of 3 degrees, in the zone around it."""
    east, north = C.reproject(F.col("x") * 0.05 + 0.5, F.col("y") * 0.5, "EPSG:4326", "EPSG:32631")
    return t.fx_nodes.select("fid", F.round(east, 3).alias("east"), (F.round(north, 3) + 0.0).alias("north"))


_B = 6378137.0 * (1 - 1 / 298.257223563)
ORACLES["geodesic_lengths"] = oracle(
    f""", q AS (SELECT 1/298.257223563 AS f), m AS (SELECT fid, c0*1.0 AS x0, r0-45.0 AS y0, (c0+c1)/2.0 AS x1, (r0+r1)/2.0-45 AS y1, c1*1.0 AS x2, r1-45.0 AS y2 FROM fx_lines),
 sg AS (SELECT fid, 1 AS part, x0 AS a, y0 AS b, x1 AS c, y1 AS d FROM m UNION ALL SELECT fid, 2, x1, y1, x2, y2 FROM m),
 u AS (SELECT fid, part, f, atan((1-f)*tan(radians(b))) AS u1, atan((1-f)*tan(radians(d))) AS u2, radians(c-a) AS l FROM sg, q WHERE a<>c OR b<>d),
 it(fid, part, f, u1, u2, l, n, lam) AS (SELECT fid, part, f, u1, u2, l, 0, l FROM u UNION ALL
  SELECT fid, part, f, u1, u2, l, n+1, l+(1-k)*f*sa*(sigma+k*ss*(cm+k*cs*(2*cm*cm-1))) FROM (
   SELECT *, f/16*ca2*(4+f*(4-3*ca2)) AS k FROM (SELECT *, CASE WHEN ca2>0 THEN cs-2*sin(u1)*sin(u2)/ca2 ELSE 0 END AS cm FROM (
    SELECT *, 1-sa*sa AS ca2 FROM (SELECT *, atan2(ss, cs) AS sigma, cos(u1)*cos(u2)*sin(lam)/ss AS sa FROM (
     SELECT *, sqrt(pow(cos(u2)*sin(lam), 2)+pow(cos(u1)*sin(u2)-sin(u1)*cos(u2)*cos(lam), 2)) AS ss, sin(u1)*sin(u2)+cos(u1)*cos(u2)*cos(lam) AS cs FROM it WHERE n<12)))))),
 en AS (SELECT *, 1+w/16384*(4096+w*(w*(320-175*w)-768)) AS big, w/1024*(256+w*(w*(74-47*w)-128)) AS small FROM (SELECT *, ca2*{(6378137.0**2 - _B**2) / _B**2!r} AS w FROM (
   SELECT *, CASE WHEN ca2>0 THEN cs-2*sin(u1)*sin(u2)/ca2 ELSE 0 END AS cm FROM (SELECT *, 1-sa*sa AS ca2 FROM (SELECT *, atan2(ss, cs) AS sigma, cos(u1)*cos(u2)*sin(lam)/ss AS sa FROM (
     SELECT *, sqrt(pow(cos(u2)*sin(lam), 2)+pow(cos(u1)*sin(u2)-sin(u1)*cos(u2)*cos(lam), 2)) AS ss, sin(u1)*sin(u2)+cos(u1)*cos(u2)*cos(lam) AS cs FROM it WHERE n=12)))))),
 ln AS (SELECT fid, SUM({_B!r}*big*(sigma-small*ss*(cm+small/4*(cs*(2*cm*cm-1)-small/6*cm*(4*ss*ss-3)*(4*cm*cm-3))))) AS metres FROM en GROUP BY 1)
SELECT x.fid, ROUND(coalesce(metres, 0), 3) AS metres FROM fx_lines x LEFT JOIN ln USING (fid)""",
    "fx_lines",
    recursive=True,
)
