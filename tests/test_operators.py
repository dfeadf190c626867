"""Micro-cases by hand, and properties against plain Python."""

import heapq
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.geodesic import geodesic_length
from tidemark.operators import catalog, graph, nearest, raster, update

SOME = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_mask_sets_permanent_water_and_nan_to_zero(spark):
    cells = spark.createDataFrame([(0, 0, 3.0, 0), (0, 1, 3.0, 1), (1, 0, float("nan"), 0), (1, 1, 2.0, None)], "r int, c int, days double, perm int")
    assert [r["days"] for r in raster.mask(cells, "days", "perm").orderBy("r", "c").collect()] == [3.0, 0.0, 0.0, 2.0]


def test_nodata_is_zero_for_one_raster_and_for_two(spark):
    cells = spark.createDataFrame([(0, 0, -99999), (0, 0, 4), (0, 1, -99999)], "r int, c int, val int")
    assert got(raster.sum_cells(cells, ["r", "c"], "val", -99999)) == [(0, 0, 4), (0, 1, 0)]


def test_nearest_tie_goes_to_lowest_fid(spark):
    nodes = spark.createDataFrame([(7, 0.0, 0.0), (3, 2.0, 0.0)], "fid long, x double, y double")
    points = spark.createDataFrame([(1, 1.0, 0.0), (2, 900.0, 0.0)], "fid long, x double, y double")
    assert got(nearest.nearest(points, nodes).select("fid", "node")) == [(1, 3), (2, 3)]
    assert got(nearest.nearest(points, nodes, max_distance=5).select("fid")) == [(1,)]
    assert got(nearest.nearest(points, nodes.where("false"))) == [(1, None, None), (2, None, None)]
    assert nearest.nearest(points, nodes.where("false"), max_distance=5).count() == 0
    lost = points.unionByName(spark.createDataFrame([(9, None, 1.0)], "fid long, x double, y double"))
    assert got(nearest.nearest(lost, nodes).select("fid", "node")) == [(1, 3), (2, 3), (9, None)]


def test_nearest_stays_in_its_country(spark):
    nodes = spark.createDataFrame([("a", 1, 0.0, 0.0), ("b", 2, 5.0, 0.0), ("a", 3, 50.0, 0.0)], "country string, fid long, x double, y double")
    points = spark.createDataFrame([("a", 1, 6.0, 0.0), ("b", 1, 1.0, 0.0), ("c", 2, 0.0, 0.0)], "country string, fid long, x double, y double")
    assert got(nearest.nearest(points, nodes, keys=["country"])) == [(1, "a", 1, 36.0), (1, "b", 2, 16.0), (2, "c", None, None)]


def test_nearest_of_crowded_nodes(spark):
    rnd = random.Random(1)
    nodes = [(i, rnd.gauss(0, 0.001), rnd.gauss(0, 0.001)) for i in range(900)] + [(1000 + i, 1e4 * rnd.random(), 1e4 * rnd.random()) for i in range(50)]
    points = [(i, rnd.gauss(0, 0.002), rnd.gauss(0, 0.002)) for i in range(60)] + [(100 + i, rnd.uniform(-1e5, 1e5), rnd.uniform(-1e5, 1e5)) for i in range(20)]
    want = [(i, min(((x - a) * (x - a) + (y - b) * (y - b), k) for k, a, b in nodes)[1]) for i, x, y in points]
    frame = lambda rows: spark.createDataFrame(rows, "fid long, x double, y double")
    assert got(nearest.nearest(frame(points), frame(nodes)).select("fid", "node")) == sorted(want, key=repr)


@SOME
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=30), st.lists(st.tuples(st.integers(-300, 300), st.integers(-9, 9)), min_size=1, max_size=20))
def test_nearest_equals_brute_force(spark, nodes, points):
    n = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(nodes)], "fid long, x double, y double")
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "fid long, x double, y double")
    want = [(i, min(((x - a) ** 2 + (y - b) ** 2, k) for k, (a, b) in enumerate(nodes))[1]) for i, (x, y) in enumerate(points)]
    assert got(nearest.nearest(p, n).select("fid", "node")) == sorted(want, key=repr)


EDGES = [(1, 2, 10), (1, 2, 4), (2, 3, 6), (3, 4, 1), (5, 1, 1)]


@pytest.mark.parametrize("local", [0, 100])
def test_reach_cutoff_direction_and_parallel_edges(spark, local):
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "fid long")
    edges = spark.createDataFrame(EDGES, "u long, v long, length int")
    found = got(graph.reach(nodes.where("fid in (1, 6)"), edges, 10, local_edges=local))
    assert found == [(1, 1, 0), (1, 2, 4), (1, 3, 10), (6, 6, 0)]
    assert got(graph.reach(nodes.where("fid = 1"), edges.where("false"), 10, local_edges=local)) == [(1, 1, 0)]
    assert graph.reach(nodes.where("false"), edges, 10, local_edges=local).count() == 0


@SOME
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 9)), min_size=1, max_size=25))
def test_reach_equals_dijkstra(spark, edges):
    def plain(src):
        best, heap = {}, [(0, src)]
        while heap:
            d, n = heapq.heappop(heap)
            if n in best:
                continue
            best[n] = d
            for u, v, w in edges:
                if u == n and d + w <= 12:
                    heapq.heappush(heap, (d + w, v))
        return best

    want = sorted(((s, n, d) for s in range(9) for n, d in plain(s).items()), key=repr)
    nodes = spark.createDataFrame([(i,) for i in range(9)], "fid long")
    frame = spark.createDataFrame(edges, "u long, v long, length int")
    assert got(graph.reach(nodes, frame, 12)) == want
    assert got(graph.reach(nodes, frame, 12, local_edges=0)) == want


def test_joined_reach_writes_fewer_rows_than_a_crowded_graph_has_pairs(spark, monkeypatch):
    n, written, write = 300, [], graph.checkpoint
    nodes = spark.range(n).withColumnRenamed("id", "fid")
    edges = spark.range(40 * n).selectExpr("id % 300 as u", "pmod(xxhash64(id), 300) as v", "1 + id % 13 as length")

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "checkpoint", counted)
    found = got(graph.reach(nodes, edges, 30, local_edges=0))
    assert found == got(graph.reach(nodes, edges, 30)) and len(found) > 0.9 * n * n
    assert sum(written) < len(found), written


def test_joined_reach_by_blocks_and_by_pairs(spark):
    nodes = spark.createDataFrame([(i,) for i in [*range(0, 90, 2), 1000]], "fid long")
    edges = spark.range(400).selectExpr("id % 90 as u", "if(id % 50 = 0, null, id * id % 97) as v", "cast((id * 7 % 31) / 4 as double) as length")
    flat = edges.groupBy("u", "v").agg(F.min("length").alias("w"))
    found = graph._reach_joined(nodes.withColumnRenamed("fid", "src"), flat.where("w <= 5"), 5, "double", block_edges=50)
    assert got(found) == got(graph.reach(nodes, edges, 5))


def _crowded(spark, n=300):
    return spark.range(40 * n).selectExpr(f"id % {n} as u", f"pmod(xxhash64(id), {n}) as v", "1 + id % 13 as length").unionByName(spark.sql("select 7000000000L as u, 5L as v, 3L as length"))


def test_access_to_a_crowded_graph_writes_no_pairs(spark, monkeypatch):
    n, written, write = 300, [], graph.checkpoint
    nodes = spark.range(n).selectExpr("id as fid", "if(id % 3 = 0, id % 7, null) as evcs_num", "if(id % 5 = 0, null, id % 4) as pop")
    nodes = nodes.unionByName(spark.sql("select explode(array(7000000000L, 900L, 901L)) as fid, 2L as evcs_num, 6L as pop"))

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out

    pairs = graph.reach(nodes.where("evcs_num is not null"), _crowded(spark), 30).join(nodes.selectExpr("fid as node", "pop"), "node").where("pop <> 0").select("src", "node", "d", "pop").collect()
    supply = {r["fid"]: r["evcs_num"] for r in nodes.collect()}
    total, a = {}, {}
    f = lambda d: math.exp(-0.5 * (d / 30) ** 2)
    for src, _, d, pop in pairs:
        total[src] = total.get(src, 0) + pop * f(d)
    for src, node, d, _ in pairs:
        a[node] = a.get(node, 0) + supply[src] / total[src] * f(d)
    want = {r["fid"]: (supply[r["fid"]] and supply[r["fid"]] / total[r["fid"]], a.get(r["fid"], 0) if r["pop"] else None) for r in nodes.collect()}
    monkeypatch.setattr(graph, "checkpoint", counted)
    for local in (0, graph.LOCAL_EDGES):
        written.clear()
        found = {r["fid"]: (r["r"], r["a"]) for r in graph.access(nodes, _crowded(spark), 30, local_edges=local).collect()}
        assert found == {k: tuple(x if x is None else pytest.approx(x) for x in v) for k, v in want.items()}
        assert sum(written) < len(pairs), written


def test_a_large_crowded_graph_is_searched_whole(spark, monkeypatch):
    nodes = spark.sql("select explode(array(0L, 1L, 299L, 900L, 7000000000L)) as fid")
    want = got(graph.reach(nodes, _crowded(spark), 13))
    plain = got(graph.reach(nodes, _crowded(spark).withColumn("length", F.col("length").cast("double")), 13))
    assert want == [(s, n, int(d)) for s, n, d in plain] and len(want) > 900
    monkeypatch.setattr(graph, "_rounds", lambda *_: pytest.fail("pair by pair"))
    assert got(graph.reach(nodes, _crowded(spark), 13, local_edges=0)) == want


def test_level_search_equals_one_by_one(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(graph, "GATHERED", 100)
    for n, many, limit, low in ((50, 3000, 30, 1), (300, 4000, 12, 3), (90, 5000, 64, 20)):
        monkeypatch.setattr(graph, "CELLS", 64 * n)
        u, v, w = rng.integers(0, n, many), rng.integers(0, n - 5, many), rng.integers(low, limit + 1, many)
        ids, first, to, cost = graph._indexed(u, v, w)
        search = graph._level_search(len(ids), first[:-1], np.arange(len(ids)), to, cost.astype(np.uint8), limit)
        for at, (found, d) in enumerate(search(np.arange(len(ids)))):
            assert dict(zip(found.tolist(), d.tolist(), strict=True)) == dict(zip(*graph._sparse_search(at, first.tolist(), to.tolist(), cost.tolist(), limit), strict=True))


def test_access_without_demand_or_supply(spark):
    nodes = spark.createDataFrame([(1, 2, 0), (2, None, 5), (3, 1, 0), (4, None, 7)], "fid long, evcs_num long, pop long")
    edges = spark.createDataFrame([(1, 2, 3)], "u long, v long, length int")
    found = {r["fid"]: (r["r"], r["a"]) for r in graph.access(nodes, edges, 10).collect()}
    f = math.exp(-0.5 * 0.09)
    assert found[1] == (pytest.approx(2 / (5 * f)), None)
    assert found[2] == (None, pytest.approx(2 / 5))
    assert found[3] == (0.0, None)
    assert found[4] == (None, 0.0)
    with pytest.raises(ValueError):
        graph.access(nodes, edges, 10, "Linear")


def test_flood_keeps_zero_edges_and_lowers_counts(spark):
    nodes = spark.createDataFrame([(1, 3, [1, 2, 3]), (2, 1, [9])], "fid long, evcs_num long, evcs_fids array<long>")
    edges = spark.createDataFrame([(1, 2, None), (1, 2, 0), (1, 2, 3)], "u long, v long, affectDays int")
    hit = graph.hit_points(spark.createDataFrame([(2, 1.0), (9, float("nan")), (1, 0.0)], "fid long, value double"))
    after, left = graph.flooded(nodes, edges, hit)
    assert got(after.select("fid", "evcs_num")) == [(1, 2), (2, 0)] and left.count() == 1


def test_updates_differ_as_they_should(spark):
    t = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "fid int, v int")
    u = spark.createDataFrame([(1, 50), (3, 70)], "fid int, v int")
    assert got(update.update_from(t, u, "fid", ["v"])) == [(1, 50), (2, 6), (3, 70)]
    assert got(update.overwrite(t, u, "fid", ["v"])) == [(1, 50), (2, None), (3, 70)]
    assert got(update.fill_null(t, u, "fid", ["v"], "v")) == [(1, 5), (2, 6), (3, 70)]
    assert got(update.fill_null_in(t, u, "fid", "v")) == [(1, 5), (2, 6), (3, 70)]


def line(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


LINE = "array<struct<x:double,y:double>>"


def test_split_gives_ordered_pieces(spark):
    edges = spark.createDataFrame([(1, 10, 20, line((0, 0), (4, 0), (4, 4)))], f"fid long, u long, v long, coords {LINE}")
    nodes = spark.createDataFrame([(10, 0.0, 0.0), (20, 4.0, 4.0), (30, 4.0, 1.0), (31, 2.0, 5e-9), (32, 3.0, 1e-3)], "fid long, x double, y double")
    found = graph.split_edges(edges, nodes).orderBy("piece").collect()
    assert [(r["u"], r["v"]) for r in found] == [(10, 31), (31, 30), (30, 20)]
    assert [tuple(p) for p in found[1]["coords"]][1] == (4.0, 0.0)


def test_topology_reverses_unless_oneway(spark):
    lines = spark.createDataFrame([(1, [line((0, 0), (1, 0)), line((1, 0), (1, 1))], '"oneway"=>"yes"'), (2, [line((0, 0), (1, 0))], '"oneway"=>"-1","lanes"=>"2"')], f"fid long, parts array<{LINE}>, other_tags string")
    nodes, edges = graph.topology(graph.with_tags(graph.parts(lines)))
    assert got(nodes.select("fid", "x", "y")) == [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0)]
    assert got(edges.select("u", "v", "key", "reversed")) == [(1, 2, 0, False), (1, 2, 1, False), (2, 1, 0, True), (2, 3, 0, False)]


def test_consolidation_follows_chains(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.5, 0.0), (3, 3.0, 0.0), (4, 30.0, 0.0)], "fid long, x double, y double")
    edges = spark.createDataFrame([(1, 2), (3, 4)], "u long, v long")
    merged, moved = graph.consolidate(nodes, edges, 1.0)
    assert got(merged) == [(1, 1.5, 0.0, 3), (4, 30.0, 0.0, 1)] and got(moved) == [(1, 4)]


@pytest.mark.parametrize(("end", "want"), [((3, 0), 4), ((0, 3), 4), ((3, 3), 4), ((0, 0), 1), ((5, 2), 6)])
def test_line_cells(spark, end, want):
    lines = spark.createDataFrame([(1, 0, 0, *end)], "fid long, c0 int, r0 int, c1 int, r1 int")
    cells = got(raster.line_cells(lines, "fid"))
    assert len(cells) == want and (1, end[1], end[0]) in cells


def test_geodesic_constants(spark):
    df = spark.createDataFrame([([0.0, 1.0], [0.0, 0.0]), ([0.0, 0.0], [0.0, 1.0]), ([5.0], [5.0]), (None, None)], "x array<double>, y array<double>")
    found = [r[0] for r in df.select(geodesic_length("x", "y")).collect()]
    assert found[0] == pytest.approx(111319.491, abs=0.01) and found[1] == pytest.approx(110574.389, abs=0.01) and found[2:] == [0.0, None]


def test_event_days_and_names(spark):
    one = spark.createDataFrame([("DFO_1_From_20020921_to_20021008.zip",)], "name string")
    assert one.select(C.event_days(F.col("name"))).first()[0] == 18
    assert catalog.byte_ranges(spark.createDataFrame([("a", 25), ("b", 0)], "name string, size long"), 10).select("start", "end").collect() == [(0, 9), (10, 19), (20, 24)]
    listing = spark.createDataFrame([("x.py",), ("a.tif",), ("folder",), ("b.zip",)], "name string")
    assert [r[0] for r in catalog.files(listing, ("zip",)).collect()] == ["a.tif", "folder"]
    assert [r[0] for r in catalog.folders(listing, ("fold",)).collect()] == ["folder"]


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(12.5, 48.25)], "x double, y double")
    x, y = C.reproject(*C.reproject(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:3857"), "EPSG:3857", "EPSG:4326")
    assert [round(v, 9) for v in df.select(x, y).first()] == [12.5, 48.25]
    with pytest.raises(ValueError):
        C.reproject(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:2154")


def test_utm(spark):
    df = spark.createDataFrame([(15.0, 45.0), (13.4, 52.5), (17.9, 0.0)], "x double, y double")
    east, north = C.reproject(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:32633")
    # The meridian arc from the equator to 45 degrees is 4984944.378 m.
    first = df.select(east.alias("e"), north.alias("n")).first()
    assert first["e"] == pytest.approx(500000, abs=1e-6) and first["n"] == pytest.approx(0.9996 * 4984944.378, abs=2e-3)
    for code in ("EPSG:32633", "EPSG:32733"):
        back = C.reproject(*C.reproject(F.col("x"), F.col("y"), "EPSG:4326", code), code, "EPSG:4326")
        assert all(abs(r["a"] - r["x"]) < 1e-9 and abs(r["b"] - r["y"]) < 1e-9 for r in df.select("x", "y", back[0].alias("a"), back[1].alias("b")).collect())


def test_updates_never_add_rows(spark):
    t = spark.createDataFrame([(1, 5, "q"), (2, 6, "q"), (2, 7, "q")], "fid int, v int, new string")
    u = spark.createDataFrame([(1, 51, "x"), (1, 50, "y"), (2, 9, "z"), (None, 1, "n")], "fid int, v int, k string")
    for f in (update.update_from, update.overwrite):
        assert got(f(t, u, "fid", ["v"])) == [(1, 50, "q"), (2, 9, "q"), (2, 9, "q")]
    assert got(update.fill_null_in(t, u, "fid", "v")) == [(1, 5, "q"), (2, 6, "q"), (2, 7, "q")]


def test_zonal_max_leaves_nan_out(spark):
    nan = float("nan")
    lines = spark.createDataFrame([(1, 0, 0, 2, 0), (2, 0, 1, 0, 1)], "fid int, c0 int, r0 int, c1 int, r1 int")
    cells = spark.createDataFrame([(9, 0, 0, 3.0), (9, 0, 1, nan), (8, 0, 2, nan), (9, 1, 0, nan)], "event int, r int, c int, days double")
    assert got(raster.zonal_max(lines, cells, "days")) == [(1, 3.0), (2, 0.0)]
    assert got(raster.zonal_max(lines, cells, "days", ["event"])) == [(1, 9, 3.0)]


def test_lines_in_coordinates_meet_cells(spark):
    # Cells of 0.5 by 0.5 from (10, 20) down; the first part turns, the second is one place.
    parts = [line((10.1, 19.9), (11.6, 19.3), (11.6, 18.1)), line((14.2, 15.2))]
    lines = spark.createDataFrame([(1, parts), (2, [])], f"fid int, parts array<{LINE}>")
    cells = got(raster.polyline_cells(lines, (10.0, 0.5, 20.0, -0.5), "fid"))
    assert cells == [(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 1, 3), (1, 2, 3), (1, 3, 3), (1, 9, 8)]
    assert got(raster.polyline_cells(lines, (10.0, 0.5, 20.0, -0.5), "fid", size=(4, 3))) == cells[:5]
    assert raster.extent((10.0, 0.5, 20.0, -0.5), 4, 6) == (10.0, 17.0, 12.0, 20.0)


def test_regions_touch_at_corners(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (1, 2), (5, 5), (6, 4), (9, 9)], "r long, c long")
    assert got(raster.regions(cells)) == [(0, 0, 1), (1, 1, 1), (1, 2, 1), (5, 5, 4), (6, 4, 4), (9, 9, 6)]


def test_countries_are_graphs_of_their_own(spark):
    lines = spark.createDataFrame([("a", 1, line((0, 0), (1, 0)), False), ("b", 2, line((0, 0), (1, 0)), True)], f"country string, fid long, coords {LINE}, oneway boolean")
    nodes, edges = graph.topology(lines, ["country"])
    assert got(nodes.select("country", "fid")) == [("a", 1), ("a", 2), ("b", 3), ("b", 4)]
    assert got(edges.select("country", "u", "v")) == [("a", 1, 2), ("a", 2, 1), ("b", 3, 4)]


def test_tables_and_ids(spark):
    t = spark.createDataFrame([(1, 5), (2, 6)], "fid int, v int")
    assert got(update.lookup(t, spark.createDataFrame([(2,), (2,)], "fid int"))) == [(2, 6)] and update.introspect(t) == [("fid", "int"), ("v", "int")]
    update.stage(t, "staged")
    assert spark.sql("select count(*) from staged").first()[0] == 2
    update.drop_table(spark, "staged")
    assert not spark.catalog.tableExists("staged")
    listing = spark.createDataFrame([('[{"id":"7","country":"Chad"},{"id":"8","country":"Congo"},{"id":"9","country":"Chad"}]',)], "body string")
    known = catalog.population_ids(listing)
    names = spark.createDataFrame([("Chad",), ("Congo, Rep.",), ("Mars",)], "country string")
    assert got(catalog.with_ids(names, known)) == [("Chad", "7"), ("Congo, Rep.", "8"), ("Mars", None)]
    shapes = spark.createDataFrame([([line((0, 0), (1, 1))],), ([line((0, 0), (0, 0))],), ([],), (None,), ([line((0, 0), (float("nan"), 1))],)], f"parts array<{LINE}>")
    assert [r[0] for r in shapes.select(C.valid_lines(F.col("parts"))).collect()] == [True, False, False, False, False]


def test_dense_and_sparse_searches_agree():
    rnd = random.Random(2)
    edges = {(rnd.randrange(30), rnd.randrange(30)): rnd.randint(1, 9) for _ in range(300)}
    rows = sorted((u, w, v) for (u, v), w in edges.items())
    first = np.searchsorted([u for u, *_ in rows], np.arange(31))
    to, cost = np.array([v for *_, v in rows]), np.array([w for _, w, _ in rows])
    for src in range(30):
        a = dict(zip(*graph._sparse_search(src, first.tolist(), to.tolist(), cost.tolist(), 7), strict=True))
        b = {int(k): int(d) for k, d in zip(*graph._dense_search(src, first, to, cost, 7), strict=True)}
        assert a == b


def test_a_crowded_search_looks_at_few_edges(monkeypatch):
    rnd = np.random.default_rng(3)
    n = 400
    to = np.concatenate([rnd.permutation(n) for _ in range(n)])
    cost = np.concatenate([np.sort(rnd.integers(1, 52, n)) for _ in range(n)])
    first = np.arange(0, n * n + 1, n)
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            found = np.asarray(self)[at]
            looked.append(np.size(found))
            return found

    a = dict(zip(*graph._sparse_search(5, first.tolist(), to.tolist(), cost.tolist(), 30), strict=True))
    b = {int(k): int(d) for k, d in zip(*graph._dense_search(5, first, to.view(Counted), cost, 30), strict=True)}
    assert a == b and len(a) == n
    assert sum(looked) < n * n / 4


def test_a_crowded_search_of_fractions_and_zeros():
    rnd = np.random.default_rng(4)
    for limit in (0, 1, 7, 1000, 0.7):
        to, first = rnd.integers(0, 38, 1600), np.arange(0, 1601, 40)
        cost = (rnd.random((40, 40)) * limit if limit == 0.7 else rnd.integers(0, limit + 1, (40, 40)))
        cost = np.sort(cost, axis=1).ravel()
        for src in (0, 39):
            a = dict(zip(*graph._sparse_search(src, first.tolist(), to.tolist(), cost.tolist(), limit), strict=True))
            b = dict(zip(*[x.tolist() for x in graph._dense_search(src, first, to, cost, limit)], strict=True))
            assert a == b


def test_cells_under_lines_are_not_gathered_on_the_driver(spark):
    lines = spark.createDataFrame([(1, 0, 0, 3, 2), (2, 5, 5, 5, 5)], "fid long, c0 long, r0 long, c1 long, r1 long")
    cells = spark.createDataFrame([(9, 0, 0, 1.0), (9, 2, 3, 3.0), (8, 2, 3, 4.0)], "event long, r long, c long, days double")
    top, per = raster.zonal_max(lines, cells, "days"), raster.zonal_max(lines, cells, "days", ["event"])
    assert got(top) == [(1, 4.0), (2, 0.0)] and got(per) == [(1, 8, 4.0), (1, 9, 3.0)]
    for found in (top, per):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
