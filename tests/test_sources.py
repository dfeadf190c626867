"""Round trips of the file formats, and resumable work."""

import io
import zipfile

import numpy as np
import pytest

from tidemark.sources import geopackage, geotiff, readers
from tidemark.sources.progress import Progress
from tidemark.streaming.incremental import process_new

GRID = (10.0, 0.5, 50.0, -0.25)


@pytest.mark.parametrize(("kind", "predictor"), [("u1", 1), ("u1", 2), ("i2", 1), ("i2", 2), ("i4", 1), ("i4", 2), ("f4", 1), ("f4", 3), ("f8", 1), ("f8", 3)])
@pytest.mark.parametrize("tile", [None, 16])
def test_tiff_round_trip(kind, tile, predictor):
    rng = np.random.default_rng(1)
    bands = rng.integers(0, 100, (2, 70, 37)).astype(kind)
    data = geotiff.write(bands, GRID, tile, predictor, nodata=-99999)
    assert all((geotiff.read(data, b + 1) == bands[b]).all() for b in range(2))
    h = geotiff.header(data)
    assert (h.width, h.height, h.bands, h.transform, h.nodata, h.crs) == (37, 70, 2, GRID, -99999, "EPSG:4326")


def lzw_packed(raw):
    """LZW by the book, highest bit first."""
    bits, n = 0, 0
    known, width = {bytes([i]): i for i in range(256)}, 9

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width

    put(256)
    held = b""
    for b in raw:
        longer = held + bytes([b])
        if longer in known:
            held = longer
            continue
        put(known[held])
        known[longer] = len(known) + 2
        if len(known) + 2 > 4094:
            width = 12
            put(256)
            known, width = {bytes([i]): i for i in range(256)}, 9
        else:
            width = max(9, (len(known) + 2).bit_length())
        held = bytes([b])
    if held:
        put(known[held])
        width = min(12, max(9, (len(known) + 3).bit_length()))
    put(257)
    return (bits << -n % 8).to_bytes((n + 7) // 8, "big")


def test_unpacking():
    rng = np.random.default_rng(3)
    for top, n in ((2, 9000), (256, 9000), (3, 1), (5, 300)):
        raw = rng.integers(0, top, n).astype("u1").tobytes()
        assert geotiff.lzw(lzw_packed(raw)) == raw
    assert geotiff.packbits(bytes([254, 170, 2, 128, 0, 42, 253, 170, 128, 0, 7])) == bytes([170] * 3 + [128, 0, 42] + [170] * 4 + [7])


def as_big(data):
    """A little-endian file of one strip or more as a BigTIFF."""
    import struct

    at = struct.unpack("<I", data[4:8])[0]
    entries, more = [], b""
    n = struct.unpack("<H", data[at : at + 2])[0]
    start = 16 + len(data)
    table = 8 + 20 * n + 8
    for k in range(n):
        tag, kind, many, raw = struct.unpack("<HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
        size = geotiff.TYPES[kind][1] * many
        value = raw[:size] if size <= 4 else data[(o := struct.unpack("<I", raw)[0]) : o + size]
        if tag in (geotiff.STRIPS, geotiff.TILES):
            kind, value = 16, struct.pack(f"<{many}Q", *[p + 16 for p in struct.unpack(f"<{many}I", value)])
        place = value.ljust(8, b"\0") if len(value) <= 8 else struct.pack("<Q", start + table + len(more))
        more += value if len(value) > 8 else b""
        entries.append(struct.pack("<HHQ", tag, kind, many) + place)
    return b"II" + struct.pack("<HHHQ", 43, 8, 0, start) + data + struct.pack("<Q", n) + b"".join(entries) + bytes(8) + more


@pytest.mark.parametrize("tile", [None, 16])
def test_big_files_and_windows(tile):
    bands = np.random.default_rng(2).integers(0, 100, (2, 70, 37)).astype("i4")
    big = as_big(geotiff.write(bands, GRID, tile, 2, nodata=-1))
    h = geotiff.header(big)
    assert (h.width, h.height, h.transform, h.nodata) == (37, 70, GRID, -1) and (geotiff.read(big, 2) == bands[1]).all()
    cut = np.zeros((70, 37), "i4")
    for r, c, v in geotiff.blocks(big, 1, (5, 3, 40, 20)):
        cut[r : r + v.shape[0], c : c + v.shape[1]] = v
    want = np.zeros((70, 37), "i4")
    want[5:40, 3:20] = bands[0, 5:40, 3:20]
    assert (cut == want).all()


def test_broken_files_are_rows(spark):
    good = geopackage.write({"edges": ([("length", "REAL")], [(5.0, [[(0.0, 0.0), (1.0, 1.0)]])], False)}, srs=32650)
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"junk"))], "path string, content binary")
    found = {r["path"]: (r["fid"], r["length"], r["error"] is None) for r in readers.vector_layer(files, {"length": "double"}, errors=True).collect()}
    assert found == {"a": (1, 5.0, True), "b": (None, None, False)}
    assert [tuple(r) for r in readers.layer_info(files.where("path = 'a'")).collect()] == [("a", 0, "edges", "LINESTRING", "EPSG:32650")]


def test_geojson_lines(spark):
    texts = [
        '{"type":"FeatureCollection","features":[{"type":"Feature","id":7,"properties":{"highway":"trunk"},"geometry":{"type":"LineString","coordinates":[[1,2],[3.5,4]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}]}',
        '{"type":"Feature","properties":{"highway":"primary"},"geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,0]],[[5,5],[6,6,9]]]}}',
    ]
    rows = readers.geojson(spark.createDataFrame([(t,) for t in texts], "value string"), {"highway": "string"}).collect()
    plain = sorted(((r["fid"], r["highway"], None if r["parts"] is None else [[tuple(p) for p in part] for part in r["parts"]]) for r in rows), key=repr)
    assert plain == [(7, "trunk", [[(1.0, 2.0), (3.5, 4.0)]]), (None, "primary", [[(0.0, 0.0), (1.0, 0.0)], [(5.0, 5.0), (6.0, 6.0)]]), (None, None, None)]


def test_flooded_points_from_csv(spark, tmp_path):
    (tmp_path / "evcs.csv").write_text("fid,values\n1,0\n2,3.5\n3,\n")
    assert [tuple(r) for r in readers.points_csv(spark, str(tmp_path / "evcs.csv")).collect()] == [(1, 0.0), (2, 3.5), (3, None)]


def test_appends_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    p = Progress(spark, str(tmp_path / "log"), "x")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: p.append(spark.createDataFrame([(f"k{k}", "i")], "key string, item string")), range(12)))
    assert len(p) == 12


def test_geopackage_round_trip():
    nodes = [("a", [[(1.0, 2.0)]]), (None, [[(3.0, 4.0)]])]
    edges = [(5, [[(0.0, 0.0), (1.0, 1.0)]]), (6, [[(0.0, 0.0), (1.0, 0.0)], [(2.0, 2.0), (3.0, 3.0)]])]
    data = geopackage.write({"nodes": ([("name", "TEXT")], nodes, True), "edges": ([("length", "REAL")], edges, False)})
    assert [n for n, _ in geopackage.layers(data)] == ["nodes", "edges"]
    assert geopackage.rows(data) == (["fid", "name", "parts"], [(1, *nodes[0]), (2, *nodes[1])])
    assert geopackage.rows(data, "edges")[1] == [(1, *edges[0]), (2, *edges[1])]
    with pytest.raises(ValueError):
        geopackage.rows(data, "rivers")


def test_archives_to_cells_and_layers(spark, tmp_path):
    bands = np.zeros((2, 5, 4), "f4")
    bands[0, 2, 3], bands[1, 0, 1] = 7, 1
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("event.tif", geotiff.write(bands, GRID))
        z.writestr("notes.txt", "x")
    (tmp_path / "AAA").mkdir()
    (tmp_path / "AAA" / "e.zip").write_bytes(zipped.getvalue())
    layer = geopackage.write({"edges": ([("length", "REAL")], [(5.0, [[(0.0, 0.0), (1.0, 1.0)]])], False)})
    (tmp_path / "AAA" / "e.gpkg").write_bytes(layer)
    members = readers.zip_members(readers.binary(spark, str(tmp_path), "*.zip"))
    assert [tuple(r) for r in members.select("country", "archive", "member").collect()] == [("AAA", "e.zip", "event.tif")]
    cells = readers.raster_cells(members, {"days": 1, "perm": 2})
    assert sorted(tuple(r) for r in cells.select("r", "c", "days", "perm").collect()) == [(0, 1, 0.0, 1.0), (2, 3, 7.0, 0.0)]
    assert readers.raster_meta(members).select("width", "height", "crs").first() == (4, 5, "EPSG:4326")
    lines = readers.vector_layer(readers.binary(spark, str(tmp_path), "*.gpkg"), {"length": "double", "lanes": "string"}, "edges")
    row = lines.first()
    assert (row["fid"], row["length"], row["lanes"], [tuple(p) for p in row["parts"][0]]) == (1, 5.0, None, [(0.0, 0.0), (1.0, 1.0)])
    feature = readers.features(lines.selectExpr("fid", "parts[0] as coords"), ["fid"]).first()[0]
    assert feature == '{"type":"Feature","properties":{"fid":1},"geometry":{"type":"LineString","coordinates":[[0.0,0.0],[1.0,1.0]]}}'
    readers.write_cells(cells.selectExpr("'AAA' as country", "1 as event", "r", "c", "days"), str(tmp_path / "out"), ["country", "event"])
    assert spark.read.parquet(str(tmp_path / "out")).where("country = 'AAA'").count() == 2


def test_progress_keeps_steps_apart(spark, tmp_path):
    p = Progress(spark, str(tmp_path / "log"), "length")
    wanted = spark.createDataFrame([("k", "a"), ("k", "b")], "key string, item string")
    assert len(p) == 0 and p.todo(wanted).count() == 2
    p.append(wanted.where("item = 'a'"))
    Progress(spark, str(tmp_path / "log"), "other").append(wanted)
    assert [r["item"] for r in p.todo(wanted).collect()] == ["b"] and len(p) == 1


def test_only_new_files_are_processed(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    work = lambda df: df.selectExpr("v * 2 as v")
    spark.createDataFrame([(1,)], "v long").write.parquet(source)
    assert process_new(spark, source, "v long", work, target, state) == 1
    assert process_new(spark, source, "v long", work, target, state) == 0
    spark.createDataFrame([(5,)], "v long").write.mode("append").parquet(source)
    assert process_new(spark, source, "v long", work, target, state) == 1
    assert sorted(r["v"] for r in spark.read.parquet(target).collect()) == [2, 10]


def test_graph_to_geopackage_files(spark):
    nodes = spark.createDataFrame([("AAA", 5, 1.0, 2.0), ("BBB", 6, 0.0, 0.0)], "country string, osmid long, x double, y double")
    edges = spark.createDataFrame([("AAA", 3.5, [(0.0, 0.0), (1.0, 2.0)])], "country string, length double, coords array<struct<x:double,y:double>>")
    files = {r["country"]: bytes(r["content"]) for r in readers.geopackage_files(nodes, edges, {"osmid": "INTEGER"}, {"length": "REAL"}).collect()}
    assert geopackage.rows(files["AAA"], "nodes")[1] == [(1, 5, [[(1.0, 2.0)]])]
    assert geopackage.rows(files["AAA"], "edges")[1] == [(1, 3.5, [[(0.0, 0.0), (1.0, 2.0)]])]
    assert geopackage.rows(files["BBB"], "edges")[1] == []


def test_a_large_graph_becomes_several_files(spark):
    nodes = spark.range(90).selectExpr("if(id < 80, 'A', 'B') as country", "id as osmid", "cast(id as double) as x", "0.5D as y")
    edges = spark.range(200).selectExpr("if(id < 190, 'A', 'B') as country", "cast(id as double) as length", "array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', cast(id as double), 'y', 1.0D)) as coords")
    made = readers.geopackage_files(nodes, edges, {"osmid": "INTEGER"}, {"length": "REAL"}, rows=50).collect()
    count = lambda f, layer: [r[1] for r in geopackage.rows(bytes(f["content"]), layer)[1]]
    assert sorted((f["country"], f["part"]) for f in made) == [("A", 0), ("A", 1), ("A", 2), ("A", 3), ("B", 0)]
    assert sorted(x for f in made for x in count(f, "nodes")) == list(range(90))
    assert sorted(x for f in made for x in count(f, "edges")) == list(range(200))
    assert max(len(count(f, "edges")) for f in made) < 90
