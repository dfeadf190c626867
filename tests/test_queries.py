"""Every registered query against its DuckDB equivalent."""

import pytest
from compare import DATA, connect, rows, sql_rows

from tidemark.plans import fixtures, registry


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    assert rows(registry.QUERIES[name](spark, DATA).toArrow()) == sql_rows(con, registry.ORACLES[name])


@pytest.mark.parametrize("name", ["accessibility_delta", "bounded_reach", "accessibility_after_flood", "accessibility_written_back", "bounded_reach_joined"])
def test_search_does_not_number_edges(spark, monkeypatch, name):
    monkeypatch.setattr(fixtures, "number", lambda *_: pytest.fail("numbered"))
    assert registry.QUERIES[name](spark, DATA.replace("sf0.01", "sf0.001")).count() > 0


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, DATA).count() > 0, name


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["fid", "r", "a"]
    assert set(e.oracle_sql()) <= set(e.queries())
