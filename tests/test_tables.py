import pytest
from pyspark.sql import functions as F

from lectern.operators import tables as T

CASES = [
    ([["Parameter", "Value"], ["Weight, kg", "12"], ["Speed, ml/h", "10"]], None),
    ([["Volume", "250 ml"]], None),
    ([["Volume", "large"]], "weak single row"),
    ([["one"], ["two words"]], "one column"),
    ([["Contents", ""], ["Intro", "5"]], "contents"),
    ([["1", "2"], ["3", "4"]], "no words"),
    ([["Name", "Value", ""], ["Weight", "", ""], ["Height", "", ""]], "sparse"),
    ([["Name", "Value"], ["Weight of it", ""]], "column without data"),
    ([["aaa#$%^&*()" * 4, "###$$$%%%^^^&&&***" * 3]], "corrupted text"),
    ([], "no words"),
    (None, "no words"),
]


def test_quality(spark):
    d = spark.createDataFrame([(i, rows, "x") for i, (rows, _) in enumerate(CASES)], "id int, rows array<array<string>>, quality string")
    got = {r.id: (r.quality.reason, r.quality.kept) for r in T.table_quality(d).collect()}
    assert got == {i: (reason, reason is None) for i, (_, reason) in enumerate(CASES)}


def test_shapes(spark):
    d = spark.createDataFrame([([["a", "", None], [" ", None], ["b"], ["c", "", "d"]],), (None,)], "rows array<array<string>>")
    assert [r.r for r in d.select(T.rectangular(F.col("rows")).alias("r")).collect()] == [[["a", ""], ["b", ""], ["c", "d"]], []]
    assert [r.r for r in d.select(F.coalesce(T.is_candidate(F.col("rows")), F.lit(False)).alias("r")).collect()] == [True, False]


@pytest.mark.parametrize(("rows", "n"), [([["Parameter", "Value"], ["Weight", "12"], ["Speed", "10"]], 1), ([["Measure", "10"], ["Weight", "12"], ["Speed", "10"]], 0), ([["Parameter", "Value"], ["Weight", "12"]], 0), ([], 0), (None, 0)])
def test_header_rows(spark, rows, n):
    assert spark.createDataFrame([(rows,)], "rows array<array<string>>").select(T.header_rows(F.col("rows")).alias("n")).first().n == n


def test_lines_outside_tables(spark):
    lines = spark.createDataFrame([("d", 1, "Parameter Value"), ("d", 1, "Speed 10 ml/h"), ("d", 1, "Other text"), ("d", 2, "Speed 10 ml/h"), ("d", 1, "---"), ("d", 1, "PARAMETER"), ("d", 1, None)], "doc string, page int, line string")
    tables = spark.createDataFrame([("d", 1, [["Parameter", "Value"], ["Speed", "10 ml/h"]])], "doc string, page int, rows array<array<string>>")
    got = T.lines_outside_tables(lines, tables).collect()
    assert sorted((r.page, str(r.line)) for r in got) == [(1, "---"), (1, "None"), (1, "Other text"), (2, "Speed 10 ml/h")]


def test_rectangular_tables_of_blank_statuses_follow_the_sql(spark, tmp_path):
    import duckdb

    from lectern.plans import catalog

    keys = [(4, 3), (8, 3), (4, 6), (5, 9), (12, 5), (16, 8), (7, 1), (8, 1)]  # customers 3 and 5 have only blank statuses and no header
    orders = spark.createDataFrame([(k, c, "1-URGENT", "F") for k, c in keys], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in catalog.QUERIES["rectangular_tables"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert got == set(con.execute(catalog.ORACLES["rectangular_tables"]).fetchall())
    assert (3, 2, 4) in got and (5, 1, 2) in got
