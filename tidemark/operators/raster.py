"""Raster operators on sparse cells: (raster keys.., r, c, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODATA = -99999


def valid(value: Column) -> Column:
    """Neither zero nor NaN nor null."""
    return (value != 0) & ~F.isnan(value.cast("double"))


def mask(cells: DataFrame, value: str, permanent: str) -> DataFrame:
    """The band with permanent water set to 0, and NaN too."""
    v = F.col(value)
    dry = F.when(F.coalesce(F.col(permanent) != 0, F.lit(False)) | F.isnan(v.cast("double")), F.lit(0)).otherwise(v)
    return cells.withColumn(value, dry.cast(cells.schema[value].dataType))


def sum_cells(cells: DataFrame, keys: list[str], value: str, nodata: float | None = None) -> DataFrame:
    """Cell-wise sum over rasters; nodata and NaN count as 0."""
    v = F.col(value)
    clean = F.when(F.isnan(v.cast("double")) | (v == F.lit(nodata) if nodata is not None else F.lit(False)), F.lit(0)).otherwise(v)
    return cells.groupBy(*keys).agg(F.sum(clean).alias(value))


AGE_GROUPS = {"children": (0, 20), "young": (25, 40), "middle": (45, 55), "elderly": (60, 80)}


def age_group(age: Column) -> Column:
    """Bucket of an age class; ages between the buckets belong to none."""
    out = F.lit(None).cast("string")
    for name, (low, high) in AGE_GROUPS.items():
        out = F.when(age.between(low, high), F.lit(name)).otherwise(out)
    return out


def grouped_sums(cells: DataFrame, value: str = "val", nodata: float = NODATA) -> DataFrame:
    """Population over all rasters, by gender, and by age class, in one pass over the cells."""
    clean = cells.withColumn(value, F.when(F.col(value) == nodata, 0).otherwise(F.col(value)))
    sets = clean.groupingSets([["r", "c"], ["r", "c", "gender"], ["r", "c", "age"]], "r", "c", "gender", "age")
    return sets.agg(F.grouping_id().alias("level"), F.sum(value).alias(value))


def line_cells(lines: DataFrame, *keep: str) -> DataFrame:
    """Cells (r, c) under straight lines from cell (c0, r0) to (c1, r1): one step a cell on the
    longer axis; the other moves by its share, halves away from the start."""
    dc, dr = F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0")
    n = F.greatest(F.abs(dc), F.abs(dr))
    steps = lines.select(*keep, "c0", "r0", dc.alias("dc"), dr.alias("dr"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("i"))
    at = lambda d: F.when(F.col("n") == 0, F.lit(0)).otherwise(F.signum(d) * F.floor((2 * F.col("i") * F.abs(d) + F.col("n")) / F.greatest(2 * F.col("n"), F.lit(1))))
    return steps.select(*keep, (F.col("r0") + at(F.col("dr"))).cast("long").alias("r"), (F.col("c0") + at(F.col("dc"))).cast("long").alias("c")).distinct()


#: x of the left edge, cell width, y of the top edge, cell height (negative when rows go down).
Affine = tuple[float, float, float, float]


def extent(affine: Affine, width: int, height: int) -> tuple[float, float, float, float]:
    """x and y lower, x and y upper of a raster."""
    x, dx, y, dy = affine
    xs, ys = sorted((x, x + dx * width)), sorted((y, y + dy * height))
    return xs[0], ys[0], xs[1], ys[1]


def polyline_cells(lines: DataFrame, affine: Affine, *keep: str, geometry: str = "parts", size: tuple[int, int] | None = None) -> DataFrame:
    """Cells (r, c) under lines in coordinates: ``geometry`` has parts, each an array of (x, y).

    Each piece between two vertices goes from the cell of one to that of the other; a part of
    one vertex is its cell. With ``size`` (width, height) pieces whose cells all lie outside
    are not followed, and other cells outside are left out.
    """
    x0, dx, y0, dy = affine
    cell = lambda p: F.struct(F.floor((p["x"] - x0) / dx).alias("c"), F.floor((p["y"] - y0) / dy).alias("r"))
    parts = lines.select(*keep, F.explode(geometry).alias("part")).select(*keep, F.transform("part", cell).alias("at"))
    follow = F.zip_with(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(1))), F.when(F.size("at") > 1, F.slice("at", F.lit(2), F.size("at") - 1)).otherwise(F.col("at")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pieces = parts.where("size(at) > 0").select(*keep, F.explode(follow).alias("s")).select(*keep, F.col("s.a.c").alias("c0"), F.col("s.a.r").alias("r0"), F.col("s.b.c").alias("c1"), F.col("s.b.r").alias("r1")).distinct()
    if size:
        w, h = size
        pieces = pieces.where((F.greatest("c0", "c1") >= 0) & (F.least("c0", "c1") < w) & (F.greatest("r0", "r1") >= 0) & (F.least("r0", "r1") < h))
        return line_cells(pieces, *keep).where(F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1))
    return line_cells(pieces, *keep)


def zonal_max(lines: DataFrame, cells: DataFrame, value: str, by: Sequence[str] = (), keys: Sequence[str] = (), under: DataFrame | None = None) -> DataFrame:
    """Largest value, neither zero nor NaN, under each line; 0 where nothing is under it.

    ``by`` keeps raster keys (an event) apart and then gives only lines that meet a cell.
    ``keys`` (a country) are of both sides: lines meet only cells that agree in them. ``under``
    has the cells of each line (keys, fid, r, c) if they are not straight from cell to cell.
    """
    keys, by = list(keys), list(by)
    under = line_cells(lines, *keys, "fid") if under is None else under
    some = cells.where(valid(F.col(value))) if not by else cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if not by:
        some = some.groupBy(*keys, "r", "c").agg(F.max(value).alias(value))
    # What a line explodes to is not in a plan's estimates: the cells of many lines would be
    # gathered on the driver to be sent around.
    met = under.hint("merge").join(some, [*keys, "r", "c"])
    if by:
        return met.groupBy(*keys, "fid", *by).agg(F.max(value).alias(value))
    top = met.groupBy(*keys, "fid").agg(F.max(value).alias(value))
    return lines.select(*keys, "fid").hint("merge").join(top, [*keys, "fid"], "left").select(*keys, "fid", F.coalesce(value, F.lit(0)).alias(value))


def worst(values: DataFrame, key: str, what: str, value: str) -> DataFrame:
    """The ``what`` with the largest value for each key (the larger name wins a tie)."""
    return values.where(valid(F.col(value))).groupBy(key).agg(F.max_by(what, F.struct(value, what)).alias(what), F.max(value).alias(value))


def sample(points: DataFrame, cells: DataFrame, value: str, origin: tuple[float, float] = (0.0, 0.0), step: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Value of the cell under each point, 0 where there is none."""
    r = F.floor((F.col("y") - origin[1]) / step[1]).cast("long").alias("r")
    c = F.floor((F.col("x") - origin[0]) / step[0]).cast("long").alias("c")
    return points.select("fid", r, c).join(cells.select("r", "c", value), ["r", "c"], "left").select("fid", F.coalesce(value, F.lit(0)).alias(value))


def clip(cells: DataFrame, bounds: tuple[float, float, float, float], origin: tuple[float, float] = (0.0, 0.0), step: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Cells inside a rectangle (x and y lower, x and y upper); a degenerate one is one cell."""
    x0, y0, x1, y1 = bounds
    rows = sorted(((y0 - origin[1]) // step[1], (y1 - origin[1]) // step[1]))
    cols = sorted(((x0 - origin[0]) // step[0], (x1 - origin[0]) // step[0]))
    return cells.where(F.col("r").between(int(rows[0]), int(rows[1])) & F.col("c").between(int(cols[0]), int(cols[1])))


def disjoint(a: str, b: str) -> Column:
    """Whether two boxes given by <name>_x0, _y0, _x1, _y1 have no point in common (touching is common)."""
    col = lambda n, s: F.col(f"{n}_{s}")
    return (col(a, "x1") < col(b, "x0")) | (col(a, "x0") > col(b, "x1")) | (col(a, "y1") < col(b, "y0")) | (col(a, "y0") > col(b, "y1"))


def pixel_sums(cells: DataFrame, nearest: DataFrame, nodes: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of the cells that belong to each node, 0 for nodes without one.

    ``nearest`` has (keys, r, c, node): it is computed once and serves every raster of the
    grid; ``keys`` (a country) tell grids apart, node numbers are unique over all.
    """
    clean = cells.where(~F.isnan(F.col(value).cast("double")) & (F.col(value) != NODATA))
    sums = clean.join(nearest, [*keys, "r", "c"]).groupBy("node").agg(F.sum(value).alias("total"))
    return nodes.select("fid").join(sums.withColumnRenamed("node", "fid"), "fid", "left").select("fid", F.coalesce("total", F.lit(0)).alias("total"))


def regions(cells: DataFrame) -> DataFrame:
    """(r, c, region) of cells that touch, corners included; a region is named by its first
    cell in row order."""
    from tidemark.operators.graph import labels, number

    named = number(cells.select("r", "c").distinct(), ["r", "c"], "fid")
    around = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))])
    beside = named.select(F.col("fid").alias("a"), "r", "c", F.explode(around).alias("d")).select("a", (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"))
    links = beside.join(named, ["r", "c"]).select("a", F.col("fid").alias("b"))
    return named.join(labels(named.select("fid"), links), "fid").select("r", "c", F.col("label").alias("region"))
