import pytest
from pyspark.sql import functions as F

from lectern.operators import cells as C
from lectern.operators import recover as R
from lectern.operators import table_parts as P

CELLS = [
    ("Site example.org here", [], ["example.org"], "Site here"),
    ("Confidential", ["confidential"], [], ""),
    ("Weight draft kg", ["draft"], [], "Weight kg"),
    ("12 r u le  value", ["rule"], [], "12 value"),
    ("max 5", ["max"], [], "max 5"),
    ("100le", ["rule"], [], "100"),
    ("п\u0075о\u0073ле", [], ["example.org"], "поле"),
    ("п\u0075оле", [], ["example.org"], "п\u0075оле"),
    ("A|B (c)", ["x"], ["(c)"], "A|B"),
    ("plain", None, None, "plain"),
    (None, ["a"], ["b"], None),
    ("", [], [], ""),
]


def test_clean_cell(spark):
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(CELLS)], "i int, t string, l array<string>, n array<string>, want string")
    got = d.select("i", "want", C.clean_cell(F.col("t"), F.col("l"), F.col("n")).alias("got")).collect()
    assert {r.i: r.got for r in got if r.want != r.got} == {}


def test_inline_noise(spark):
    d = spark.createDataFrame([("See WWW  site now", ["www site", None, ""]), ("a .org b.org", [".org"]), (None, ["x"])], "t string, n array<string>")
    assert [r.r for r in d.select(C.remove_inline_noise(F.col("t"), F.col("n")).alias("r")).collect()] == ["See now", "a b.org", None]


def test_recover(spark):
    def row(ix, top, *texts, bottom=None):
        return ("d", 1, ix, float(top), float(bottom or top + 10), 600.0, [(t, 50.0 + 200 * k, 150.0 + 200 * k) for k, t in enumerate(texts)])

    rows = [row(0, 0, "Table 1", "Name"), row(1, 12, "a", "1"), row(2, 24, "b", "2"), row(3, 36, "Table 2", "Value"), row(4, 48, "c", "3"), row(5, 60, "d", None), row(6, 72, "", None),
            row(7, 200, "name and value", "x"), row(8, 212, "e", "5"), row(9, 224, "1. Heading of it"), row(10, 236, "table", "x"), row(11, 248, "f", "6", "z", "q"), row(12, 260, "g", "7")]
    d = spark.createDataFrame(rows, "doc string, page int, ix int, top double, bottom double, page_right double, cells array<struct<text:string,left:double,right:double>>")
    got = [(r.island, [x[0] for x in r.rows], r.right) for r in R.recover_tables(d).orderBy("island").collect()]
    assert got == [(1, ["Table 1", "a", "b"], 350.0), (2, ["Table 2", "c", "d"], 350.0), (3, ["table", "f", "g"], 350.0)]
    assert R.recover_tables(d.limit(0)).count() == 0


@pytest.mark.parametrize("budget", [16, 20, 37, 80, 1000])
def test_parts_hold_everything(budget):
    rows = [["Name", "Value"]] + [[f"row{i} with words", f"v{i}"] for i in range(40)] + [["long " * 60, "x|y"]]
    fits = lambda t: len(t.split()) <= budget
    parts = P.split_table(rows, 1, fits)
    assert all(fits(t) for t, _, _ in parts)
    text = "\n".join(t for t, _, _ in parts)
    assert all(text.count(f"v{i} ") + text.count(f"v{i}\n") == 1 for i in range(40)) and text.count("long") == 60
    assert [a for _, a, _ in parts] == sorted(a for _, a, _ in parts) and parts[-1][2] == len(rows) - 1
    if len(parts) > 1:
        assert all(f"{k}/{len(parts)}]" in t for k, (t, _, _) in enumerate(parts, 1))


def test_budget_below_the_tags():
    with pytest.raises(ValueError):
        P.split_table([["a b", "c"]], 0, lambda t: len(t.split()) <= 7)


def test_table_parts(spark):
    d = spark.createDataFrame([("d", 1, [["a", "b"], ["c", None]], [3, 4], 1), ("d", 2, None, None, 0), ("d", 3, [["word " * 50]], [1], None)], "doc string, table int, rows array<array<string>>, pages array<int>, n_header int")
    got = {(r.table, r.part): (r.content, r.first_page, r.last_page, r.error) for r in P.table_parts(d, 4 + 10).collect()}
    assert got[(1, 1)] == ("[TABLE]\n| a | b |\n| c |  |\n[/TABLE]", 3, 4, None) and max(t for t, _ in got) == 3
    assert [r.error for r in P.table_parts(d.where("table = 3"), 3).collect()] == ["a table cell doesn't fit"]
