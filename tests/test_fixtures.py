"""Fixtures keep all rows of the tables they are derived from."""

from compare import DATA

from tidemark.plans import fixtures


def test_archives_and_edges_read_whole_tables(spark):
    orders, lineitem, supplier = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("orders", "lineitem", "supplier"))
    assert fixtures.load(spark, DATA, "fx_archives").count() == orders.count()
    n = supplier.count()
    kinds = lineitem.selectExpr("l_suppkey", f"l_partkey % {n}", "cast(l_quantity as int)", "if(l_returnflag = 'R', cast(l_quantity as int), 0)").distinct()
    assert fixtures.load(spark, DATA, "fx_edges").count() == kinds.count()
