"""GeoPackage layers of points and lines: SQLite bytes to rows and back."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterable

ENVELOPES = (0, 32, 48, 48, 64)


def geometry(blob: bytes | None) -> list[list[tuple[float, float]]] | None:
    """Parts (lists of x, y) of a point, line, or multi-point or multi-line."""
    if blob is None or blob[:2] != b"GP":
        return None
    return _wkb(blob, 8 + ENVELOPES[blob[3] >> 1 & 7])[0]


def _wkb(b: bytes, at: int) -> tuple[list, int]:
    order = "<" if b[at] else ">"
    kind = struct.unpack_from(order + "I", b, at + 1)[0]
    at += 5
    if kind == 1:
        return [[struct.unpack_from(order + "2d", b, at)]], at + 16
    n = struct.unpack_from(order + "I", b, at)[0]
    at += 4
    if kind == 2:
        flat = struct.unpack_from(f"{order}{2 * n}d", b, at)
        return [list(zip(flat[::2], flat[1::2], strict=True))], at + 16 * n
    if kind in (4, 5):
        out = []
        for _ in range(n):
            part, at = _wkb(b, at)
            out += part
        return out, at
    raise ValueError(f"geometry type {kind}")


def blob(parts: list[list[tuple[float, float]]], srs: int = 4326, point: bool = False) -> bytes:
    line = lambda p: b"\x01" + struct.pack("<II", 2, len(p)) + b"".join(struct.pack("<2d", *q) for q in p)
    if point:
        body = b"\x01" + struct.pack("<I2d", 1, *parts[0][0])
    elif len(parts) == 1:
        body = line(parts[0])
    else:
        body = b"\x01" + struct.pack("<II", 5, len(parts)) + b"".join(map(line, parts))
    return b"GP\x00\x01" + struct.pack("<i", srs) + body


def layers(data: bytes) -> list[tuple[str, str]]:
    """(name, geometry column) of the feature layers, in order."""
    with _opened(data) as db:
        return [(n, c) for n, c in db.execute("SELECT c.table_name, g.column_name FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) ORDER BY c.rowid")]


def described(data: bytes) -> list[tuple[str, str, str]]:
    """(name, geometry type, system) of the feature layers, in order."""
    with _opened(data) as db:
        return [(n, g, f"{org}:{code}") for n, g, org, code in db.execute("SELECT c.table_name, g.geometry_type_name, s.organization, s.organization_coordsys_id FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) JOIN gpkg_spatial_ref_sys s ON s.srs_id = g.srs_id ORDER BY c.rowid")]


def rows(data: bytes, layer: str | None = None) -> tuple[list[str], Iterable[tuple]]:
    """Column names and rows of a layer (the first without a name), geometry as parts.

    ``fid`` is the row's number from 1 on.
    """
    known = dict(layers(data))
    if not known or layer not in (None, *known):
        raise ValueError(f"no layer {layer!r} in {sorted(known)}")
    name = layer or next(iter(known))
    with _opened(data) as db:
        found = db.execute('SELECT * FROM "{}" ORDER BY rowid'.format(name.replace('"', '""')))
        names = [d[0] for d in found.description]
        g = names.index(known[name])
        keep = [k for k, n in enumerate(names) if n != "fid" and k != g]
        out = [(i, *[row[k] for k in keep], geometry(row[g])) for i, row in enumerate(found, 1)]
    return ["fid", *[names[k] for k in keep], "parts"], out


def write(tables: dict[str, tuple[list[tuple[str, str]], Iterable[tuple], bool]], srs: int = 4326) -> bytes:
    """Layers by name: (columns with SQL types, rows ending in parts, whether points)."""
    db = sqlite3.connect(":memory:")
    db.execute("PRAGMA application_id=1196444487")
    db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?,?,?,?,?,?)", (f"EPSG:{srs}", srs, "EPSG", srs, "undefined", None))
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
    for name, (columns, data, points) in tables.items():
        fields = ", ".join(f'"{c}" {t}' for c, t in columns)
        db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY, {fields}{", " if fields else ""}geom BLOB)')
        marks = ",".join("?" * (len(columns) + 1))
        names = ", ".join([*(f'"{c}"' for c, _ in columns), "geom"])
        db.executemany(f'INSERT INTO "{name}" ({names}) VALUES ({marks})', ((*r[:-1], blob(r[-1], srs, points)) for r in data))
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?,'features',?,?)", (name, name, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?,'geom',?,?,0,0)", (name, "POINT" if points else "LINESTRING", srs))
    db.commit()
    return db.serialize()


class _opened:
    """A database in memory for the length of a block."""

    def __init__(self, data: bytes):
        self.db = sqlite3.connect(":memory:")
        self.db.deserialize(data)

    def __enter__(self) -> sqlite3.Connection:
        return self.db

    def __exit__(self, *_) -> None:
        self.db.close()
