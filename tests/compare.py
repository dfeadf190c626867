"""Rows of a Spark and of a DuckDB result, without order."""

import math
import os

import duckdb

#: The tables that the tests read.
DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, list):
        return [value(x) for x in v]
    return v


def rows(table):
    columns = sorted(table.column_names)
    return columns, sorted(repr([value(r[c]) for c in columns]) for r in table.to_pylist())


def sql_rows(con, sql):
    found = con.sql(sql).arrow()
    return rows(found.read_all() if hasattr(found, "read_all") else found)
