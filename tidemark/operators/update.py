"""Table mutation as joins: the four ways to update a column from another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _joined(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Target rows as ``t`` with what the other table has for them as ``new``, or null.

    An update never adds rows: of several rows for a key the least counts, by the columns in
    their order, nulls first.
    """
    one = updates.groupBy(F.col(key).alias("k")).agg(F.min(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])).alias("new"))
    rows = target.select(F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("t"))
    return rows.join(one, F.col(f"t.`{key}`") == F.col("k"), "left")


def _new(columns: list[str], column: str) -> Column:
    return F.col(f"new.c{columns.index(column)}")


def _old(column: str) -> Column:
    return F.col(f"t.`{column}`")


def _result(joined: DataFrame, target: DataFrame, values: dict[str, Column]) -> DataFrame:
    return joined.select(*[values.get(c, _old(c)).alias(c) for c in target.columns])


def update_from(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Matched rows take the new value; unmatched ones keep theirs."""
    j = _joined(target, updates, key, columns)
    return _result(j, target, {c: F.when(F.col("k").isNotNull(), _new(columns, c)).otherwise(_old(c)) for c in columns})


def overwrite(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every row takes what the other table has for it: null where that is nothing."""
    j = _joined(target, updates, key, columns)
    return _result(j, target, {c: _new(columns, c) for c in columns})


def fill_null(target: DataFrame, updates: DataFrame, key: str, columns: list[str], guard: str) -> DataFrame:
    """Rows whose guard column is null take the new values in all columns."""
    j = _joined(target, updates, key, columns)
    return _result(j, target, {c: F.when(_old(guard).isNull(), _new(columns, c)).otherwise(_old(c)) for c in columns})


def fill_null_in(target: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Rows that the other table names and whose value is null take the new one."""
    j = _joined(target, updates, key, [column])
    return _result(j, target, {column: F.coalesce(_old(column), _new([column], column))})


def add_fields(table: DataFrame, fields: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns that are missing, (type, default) by name."""
    return table.withColumns({n: F.lit(d).cast(t) for n, (t, d) in fields.items() if n not in table.columns})


def drop_fields(table: DataFrame, *names: str) -> DataFrame:
    """Drops columns; names that are not there are ignored."""
    return table.drop(*names)


def lookup(table: DataFrame, fids: DataFrame, key: str = "fid") -> DataFrame:
    """Rows of the given ids, each once however often it is asked for."""
    return table.join(fids.select(key), key, "left_semi")


def introspect(table: DataFrame) -> list[tuple[str, str]]:
    """(column, type) of a table, in order."""
    return [(f.name, f.dataType.simpleString()) for f in table.schema.fields]


def stage(rows: DataFrame, name: str = "tempTable") -> None:
    """A named view of rows for SQL; one that is there is replaced."""
    rows.createOrReplaceTempView(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Forgets a view or a table, if there is one."""
    spark.catalog.dropTempView(name)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
