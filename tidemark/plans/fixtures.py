"""Inputs of the registered queries, derived from the driver tables by SQL that Spark and
DuckDB run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.graph import number

SQL = {
    "fx_nodes": """SELECT s_suppkey+1 AS fid, (s_suppkey*37)%101 AS x, (s_suppkey*53)%97 AS y,
       CAST(CASE WHEN s_acctbal>0 THEN FLOOR(s_acctbal) ELSE 0 END AS BIGINT) AS pop FROM supplier""",
    "fx_points": "SELECT c_custkey+1 AS fid, (c_custkey*29)%101 AS x, (c_custkey*31)%97 AS y FROM customer",
    "fx_edges": """SELECT CAST(ROW_NUMBER() OVER (ORDER BY u, v, length, affectDays) AS BIGINT) AS fid, u, v,
       CAST(ROW_NUMBER() OVER (PARTITION BY u, v ORDER BY length, affectDays)-1 AS BIGINT) AS key, length, affectDays
FROM (SELECT DISTINCT l_suppkey+1 AS u, l_partkey%(SELECT COUNT(*) FROM supplier)+1 AS v,
             1+CAST(l_quantity AS INT) AS length,
             CASE WHEN l_returnflag='R' THEN CAST(l_quantity AS INT) ELSE 0 END AS affectDays
      FROM lineitem) t""",
    "fx_flood": """SELECT l_linenumber AS event, l_partkey%97 AS r, l_suppkey%101 AS c, MAX(CAST(l_quantity AS INT)) AS days,
       MAX(CASE WHEN l_linestatus='O' AND l_returnflag='R' THEN 1 ELSE 0 END) AS perm
FROM lineitem GROUP BY l_linenumber, l_partkey%97, l_suppkey%101""",
    "fx_pop": """SELECT CASE WHEN l_linestatus='F' THEN 'f' ELSE 'm' END AS gender,
       CASE WHEN l_linenumber=1 THEN 1 ELSE (l_linenumber-2)*15 END AS age, l_partkey%97 AS r, l_suppkey%101 AS c,
       CASE WHEN MIN(l_discount)=0 THEN -99999 ELSE SUM(CAST(l_quantity AS INT)) END AS val
FROM lineitem GROUP BY 1,2,3,4""",
    "fx_affected": "SELECT fid, CASE WHEN fid%5=0 THEN 3 ELSE 0 END AS value FROM fx_points",
    "fx_lines": """SELECT p_partkey+1 AS fid, (p_partkey*7)%95 AS c0, (p_partkey*11)%91 AS r0,
       (p_partkey*7)%95  + CASE WHEN p_size%3=1 THEN 0 ELSE p_size%5 END AS c1,
       (p_partkey*11)%91 + CASE WHEN p_size%3=0 THEN 0 ELSE p_size%5 END AS r1,
       CASE p_size%6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary'
                     WHEN 3 THEN 'secondary_link' WHEN 4 THEN 'residential' ELSE 'footway' END AS highway,
       CONCAT('"oneway"=>"', CASE WHEN p_size%4=0 THEN 'yes' WHEN p_size%4=1 THEN '-1' ELSE 'no' END, '"',
              CASE WHEN p_size%2=0 THEN CONCAT(',"lanes"=>"', CAST(1+p_size%4 AS STRING), '"') ELSE '' END) AS other_tags
FROM part""",
    "fx_archives": """SELECT CONCAT('N', CAST(o_custkey%25 AS STRING)) AS country,
       CONCAT('DFO_', CAST(o_orderkey AS STRING), '_From_', REPLACE(CAST(CAST(o_orderdate AS DATE) AS STRING),'-',''),
              '_to_', REPLACE(CAST(CAST(o_orderdate AS DATE)+CAST(o_orderkey%30 AS INT) AS STRING),'-',''), '.zip') AS name
FROM orders""",
}

#: Tables and fixtures that each fixture reads.
READS = {
    "fx_nodes": ["supplier"],
    "fx_points": ["customer"],
    "fx_edges": ["lineitem", "supplier"],
    "fx_flood": ["lineitem"],
    "fx_pop": ["lineitem"],
    "fx_affected": ["fx_points"],
    "fx_lines": ["part"],
    "fx_archives": ["orders"],
}


#: Fixtures with a number over all rows: DuckDB counts them in a window, Spark over ranges.
NUMBERED = {"fx_edges": ("fid", ["u", "v", "length", "affectDays"], "CAST(ROW_NUMBER() OVER (ORDER BY u, v, length, affectDays) AS BIGINT) AS fid, ")}


def unnumbered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A numbered fixture without what a window counts: nothing is written or sorted for it."""
    _, order, window = NUMBERED[name]
    return _sql(spark, sf_dir, name, SQL[name].replace(window, "")).select(*order)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture or a driver table."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SQL[name]
    if name in NUMBERED:
        column, order, window = NUMBERED[name]
        return number(_sql(spark, sf_dir, name, sql.replace(window, "")), order, column).select(column, "u", "v", "key", "length", "affectDays")
    return _sql(spark, sf_dir, name, sql)


def _sql(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    for read in READS[name]:
        sql = sql.replace(f"FROM {read}", f"FROM {{{read}}}")
    return spark.sql(sql, **{read: load(spark, sf_dir, read) for read in READS[name]})


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL over fixtures: ``body`` may go on with further common table expressions."""
    wanted: list[str] = []
    for n in names:
        wanted += [r for r in READS[n] if r in SQL and r not in wanted] + ([n] if n not in wanted else [])
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.startswith("WITH "):
        return f"{head}{parts}, {body[5:]}"
    return f"{head}{parts}{body}" if body.startswith(",") else f"{head}{parts} {body}"
