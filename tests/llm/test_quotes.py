import duckdb
import pandas as pd
from compare import connect, rows, sql_rows


from tidemark.llm import quotes as Q

HARD = [
    (1, 0, "user", "Hello there\nhow are you"), (1, 1, "assistant", "> Hello   THERE\n> how are you\nfine\n\nand you?"), (1, 2, "user", "> > hello there\n> fine\nok > not a quote"),
    (1, 3, "user", ">> fine\n> ok > not a quote\n"), (1, 4, "user", None), (2, 0, "user", "> fine\nx"), (2, 1, "user", ""), (1, 5, "user", "> unknown\n> fine\nreply"),
    (1, 6, "a", "> and you?\n>\n> reply\nz"), (1, 6, "b", "> reply"), (3, 0, "u", "same line\n" * 50), (3, 1, "u", "> same line\n" * 50), (3, 2, "u", "> same line"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_hard_messages_equal_sql(spark):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(HARD, columns=["conv_id", "turn", "role", "text"]))
    found = Q.link(spark.createDataFrame(HARD, SCHEMA).repartition(3))
    assert rows(found.toArrow()) == sql_rows(con, Q.OP8_SQL)
    by = {(r["conv_id"], r["turn"], r["role"]): r for r in found.collect()}
    assert [by[1, t, "user"]["position"] for t in (0, 2, 3, 4, 5)] == [1, 3, 4, 7, 5]
    assert by[1, 3, "user"]["root_turn"] == 0 and by[1, 3, "user"]["depth"] == 3 and by[1, 6, "a"]["body"] == "z"


def test_table_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert rows(Q.op8_quotation_links(spark, sf_dir).toArrow()) == sql_rows(connect(sf_dir), Q.OP8_SQL)


def test_nulls_and_no_rows(spark):
    odd = spark.createDataFrame([(None, 0, "u", "> x"), (1, None, "u", "x"), (1, 1, None, "> x")], SCHEMA).withColumn("hash", Q.F.lit(1))
    assert Q.link(odd).count() == 3 and sorted(str(r["position"]) for r in Q.link(odd).collect()) == ["1", "None", "None"]
    assert Q.link(spark.createDataFrame([], SCHEMA)).count() == 0
