"""Scalar functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance decays by name: a function of distance and its scale.
DECAYS: dict[str, Callable[[Column, float], Column]] = {}


def register_decay(name: str, fn: Callable[[Column, float], Column]) -> None:
    DECAYS[name] = fn


register_decay("Gaussian", lambda d, scale: F.exp(F.lit(-0.5) * F.pow(d / F.lit(float(scale)), F.lit(2.0))))


def decay(name: str, distance: Column, scale: float) -> Column:
    if name not in DECAYS:
        raise ValueError(f"unknown decay {name!r}; known: {sorted(DECAYS)}")
    return DECAYS[name](distance, scale)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, kind: str = "bigint", block: int = 64, levels: int = 2) -> Column:
    """Sums of an array up to and with each element.

    A fold that appends copies what it has at every step, so only blocks are folded, and then
    the sums of blocks; that stays linear up to block ** (levels + 1) elements and long beyond.
    """

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast(kind).alias("sum"), F.array().cast(f"array<{kind}>").alias("all"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["sum"] + x).cast(kind).alias("sum"), F.concat(a["all"], F.array((a["sum"] + x).cast(kind))).alias("all")))["all"]

    def cut(xs: Column, level: int) -> Column:
        if not level:
            return fold(xs)

        def blocks(v: Column) -> Column:
            many = F.ceil(F.size(v) / F.lit(block)).cast("int")
            inner = F.transform(F.sequence(F.lit(1), many), lambda b: fold(F.slice(v, (b - 1) * block + 1, F.lit(block))))
            return let(inner, moved)

        def moved(inner: Column) -> Column:
            ends = cut(F.transform(inner, lambda x: F.element_at(x, -1)), level - 1)
            return F.flatten(let(ends, lambda e: F.zip_with(inner, e, lambda x, end: F.transform(x, lambda k: k + (end - F.element_at(x, -1))))))

        return F.when(F.size(xs) > 0, let(xs, blocks)).otherwise(F.array().cast(f"array<{kind}>"))

    return cut(values, levels)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom where bottom is positive, else 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def name_part(name: Column, sep: str, index: int) -> Column:
    """0-based part of a separated name, null when there are fewer."""
    return F.get(F.split(name, f"\\Q{sep}\\E"), F.lit(index))


def suffix(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def tag(tags: Column, key: str) -> Column:
    """Value of a key in hstore-like text, null when it is not there."""
    return F.nullif(F.regexp_extract(tags, f'"{key}"=>"([^"]*)"', 1), F.lit(""))


def all_tags(tags: Column) -> Column:
    """The whole text as a map."""
    keys = F.regexp_extract_all(tags, F.lit('"([^"]*)"=>"[^"]*"'), F.lit(1))
    values = F.regexp_extract_all(tags, F.lit('"[^"]*"=>"([^"]*)"'), F.lit(1))
    return F.map_from_arrays(keys, values)


def event_days(name: Column) -> Column:
    """Days of an archive named ..._From_yyyymmdd_to_yyyymmdd.ext, both ends included."""
    start = F.to_date(name_part(name, "_", 3), "yyyyMMdd")
    end = F.to_date(F.left(name_part(name, "_", 5), F.lit(8)), "yyyyMMdd")
    return F.datediff(end, start) + 1


def cell_centre(index: Column, origin: float, step: float) -> Column:
    return F.lit(origin) + (index + 0.5) * step


def cell_of(coordinate: Column, origin: float, step: float) -> Column:
    return F.floor((coordinate - origin) / step)


def lossy32(x: Column) -> Column:
    """A coordinate after a round through 32 bits."""
    return x.cast("float").cast("double")


def affected(value: Column) -> Column:
    """Anything but zero counts, null and NaN included."""
    return F.coalesce((value != 0) | F.isnan(value.cast("double")), F.lit(True))


def mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude to spherical web Mercator metres."""
    r = 6378137.0
    return F.radians(x) * r, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(y) / 2)) * r


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.degrees(x / r), F.degrees(F.atan(F.exp(y / r)) * 2 - 1.5707963267948966)


#: WGS84 and the universal transverse Mercator. Fixed values.
_A, _FLAT, _SCALE, _EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _FLAT / (2 - _FLAT)
_MERIDIAN = _SCALE * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_TO = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_FROM = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude to metres of a UTM zone, by a series in the third flattening."""
    e = 2 * _N**0.5 / (1 + _N)
    phi, lam = F.sin(F.radians(y)), F.radians(x - F.lit(6.0 * zone - 183))
    t = F.sinh(F.atanh(phi) - e * F.atanh(e * phi))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_TO, 1))
    north = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_TO, 1))
    return east * _MERIDIAN + _EAST, north * _MERIDIAN + (1e7 if south else 0.0)


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    xi, eta = (y - (1e7 if south else 0.0)) / _MERIDIAN, (x - _EAST) / _MERIDIAN
    up = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_FROM, 1))
    over = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_FROM, 1))
    chi = F.asin(F.sin(up) / F.cosh(over))
    phi = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(_LATITUDE, 1))
    return F.degrees(F.atan2(F.sinh(over), F.cos(up))) + (6.0 * zone - 183), F.degrees(phi)


def valid_lines(parts: Column) -> Column:
    """Whether a geometry has parts and each has two places at least, all of them numbers."""
    good = lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"].cast("double")) & ~F.isnan(p["y"].cast("double"))
    part = lambda p: (F.size(F.array_distinct(p)) > 1) & F.forall(p, good)
    return F.coalesce((F.size(parts) > 0) & F.forall(parts, part), F.lit(False))


def reproject(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Between EPSG:4326, EPSG:3857 and the UTM zones EPSG:326xx and 327xx; other systems are
    refused, not guessed."""
    if source == target:
        return x, y
    for name in (source, target):
        if name not in ("EPSG:4326", "EPSG:3857") and not (re.fullmatch(r"EPSG:32[67]\d\d", name) and 1 <= int(name[-2:]) <= 60):
            raise ValueError(f"no transform from {source} to {target}")
    zone = lambda name: (int(name[-2:]), name[7] == "7")
    if source == "EPSG:3857":
        x, y = from_mercator(x, y)
    elif source != "EPSG:4326":
        x, y = from_utm(x, y, *zone(source))
    if target == "EPSG:3857":
        return mercator(x, y)
    return (x, y) if target == "EPSG:4326" else utm(x, y, *zone(target))
