"""Nearest-neighbour join by descent of a tree of cells, without comparing all pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.lineage import checkpoint

#: Nodes of a cell that is not split any more.
LEAF = 32
#: Each cell is split into FAN x FAN; levels beyond what evenly spread nodes need.
FAN, SPARE = 4, 4
#: Levels that one plan goes down.
STRIDE = 4


def _box(x: Column, y: Column, b: Column) -> tuple[Column, Column]:
    """Squared distances to the nearest and to the farthest place of a cell's box."""
    zero = F.lit(0.0)
    dx, dy = F.greatest(b["x0"] - x, x - b["x1"], zero), F.greatest(b["y0"] - y, y - b["y1"], zero)
    fx, fy = F.greatest(F.abs(x - b["x0"]), F.abs(x - b["x1"])), F.greatest(F.abs(y - b["y0"]), F.abs(y - b["y1"]))
    return dx * dx + dy * dy, fx * fx + fy * fy


def nearest(points: DataFrame, nodes: DataFrame, max_distance: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(fid, keys, node, d2) of the nearest node (the lowest fid wins a tie) of each point.

    With ``keys`` (a country) only nodes with the same values count. A point without
    coordinates, or without any such node, has a null node. With ``max_distance`` only points
    with a node that near are returned.

    Cells with more than LEAF places are split, so dense areas have small cells and empty ones
    none. A point goes down from the whole extent and at each level keeps the cells that may
    hold its nearest node: those no farther than the farthest place of the best one. It meets
    nodes of a few leaves, however the nodes are spread and however far it is.
    """
    keys = list(keys)
    rows = points.select("fid", *keys, "x", "y")
    places = nodes.where("x is not null and y is not null").groupBy(*keys, "x", "y").agg(F.min("fid").alias("node"))
    places = checkpoint(places)
    box = places.agg(F.count("*").alias("n"), *[f(F.col(c).cast("double")).alias(f"{k}{c}") for k, f in (("a", F.min), ("b", F.max)) for c in ("x", "y")]).first()
    told = rows.where("x is not null and y is not null")
    if not box["n"]:
        zero = (F.col("x") - F.col("x")) * (F.col("y") - F.col("y"))
        return rows.where(F.lit(max_distance is None)).select("fid", *keys, F.lit(None).cast(places.schema["node"].dataType).alias("node"), F.nullif(zero, zero).alias("d2"))
    wide = max(box["bx"] - box["ax"], box["by"] - box["ay"]) or 1.0
    depth = max(0, math.ceil(math.log(max(1.0, box["n"] / LEAF), FAN * FAN))) + SPARE
    found = _descend(told, places, keys, (box["ax"], box["ay"], wide), depth, max_distance)
    if max_distance is not None:
        return found
    return rows.select("fid", *keys).join(found, ["fid", *keys], "left").select("fid", *keys, "node", "d2")


def _descend(points: DataFrame, places: DataFrame, keys: list[str], frame: tuple[float, float, float], depth: int, max_distance: float | None) -> DataFrame:
    ax, ay, wide = frame

    def cell(c: str, start: float, level: Column) -> Column:
        many = F.pow(F.lit(float(FAN)), level)
        at = F.floor((F.col(c).cast("double") - start) / wide * many)
        return F.greatest(F.lit(0), F.least(at, many.cast("long") - 1)).cast("long")

    leveled = places.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    leveled = leveled.select(*keys, "node", "x", "y", "level", cell("x", ax, F.col("level")).alias("cx"), cell("y", ay, F.col("level")).alias("cy"))
    fx, fy = F.col("x").cast("double"), F.col("y").cast("double")
    cells = leveled.groupBy(*keys, "level", "cx", "cy").agg(F.count("*").alias("n"), F.struct(F.min(fx).alias("x0"), F.max(fx).alias("x1"), F.min(fy).alias("y0"), F.max(fy).alias("y1")).alias("box"))
    inner = (F.col("n") > LEAF) & (F.col("level") < depth)
    child = F.struct("level", "cx", "cy", inner.alias("inner"), "box")
    up = lambda c: F.floor(F.col(c) / FAN).cast("long").alias(c)
    tree = cells.where("level > 0").select(*keys, (F.col("level") - 1).alias("level"), up("cx"), up("cy"), "n", child.alias("child"))
    tree = checkpoint(tree.groupBy(*keys, "level", "cx", "cy").agg(F.sum("n").alias("n"), F.collect_list("child").alias("children")).where(F.col("n") > LEAF).drop("n"))
    deepest = tree.agg(F.max("level")).first()[0]
    roots = cells.where("level = 0").select(*keys, F.struct("level", "cx", "cy", inner.alias("inner"), "box").alias("at"))
    if keys:
        held = points.join(roots, keys)
    else:
        root = roots.first()["at"]
        whole = F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(root["inner"]).alias("inner"), F.struct(*[F.lit(root["box"][c]).alias(c) for c in ("x0", "x1", "y0", "y1")]).alias("box"))
        held = points.withColumn("at", whole)
    px, py = F.col("x").cast("double"), F.col("y").cast("double")
    for level in range(-1 if deepest is None else deepest + 1):
        step = tree.where(F.col("level") == level).select(*keys, F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "children")
        same = F.col("at.inner") & (F.col("at.cx") == F.col("_cx")) & (F.col("at.cy") == F.col("_cy"))
        for k in keys:
            same = same & (held[k] == step[k])
        opened = held.join(step, same, "left").select("fid", *[held[k] for k in keys], "x", "y", F.explode(F.coalesce("children", F.array("at"))).alias("at"))
        low, high = _box(px, py, F.col("at.box"))
        bound = F.min("high").over(W.partitionBy("fid", *keys))
        held = opened.withColumns({"low": low, "high": high}).withColumn("bound", bound).where(F.col("low") <= F.col("bound"))
        if max_distance is not None:
            held = held.where(F.col("low") <= float(max_distance) ** 2)
        held = held.select("fid", *keys, "x", "y", "at")
        if level % STRIDE == STRIDE - 1:
            held = checkpoint(held)
    leaves = held.select("fid", *keys, "x", "y", F.col("at.level").alias("level"), F.col("at.cx").alias("cx"), F.col("at.cy").alias("cy"))
    met = leaves.join(leveled.where(F.col("level") <= (0 if deepest is None else deepest + 1)).withColumnsRenamed({"x": "nx", "y": "ny"}), [*keys, "level", "cx", "cy"])
    d2 = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    best = met.groupBy("fid", *keys).agg(F.min(F.struct(d2.alias("d2"), "node")).alias("best")).select("fid", *keys, "best.node", "best.d2")
    return best if max_distance is None else best.where(F.col("d2") <= float(max_distance) ** 2)


def count_and_list(linked: DataFrame) -> DataFrame:
    """Points of each node: how many, and their ids in order."""
    return linked.where("node is not null").groupBy("node").agg(F.count("*").alias("evcs_num"), F.array_sort(F.collect_list("fid")).alias("evcs_fids"))
