from pyspark.sql import functions as F

from lectern.operators import headings as H
from lectern.operators import overlap as O
from lectern.operators import plan as P

ROWS = "rows array<array<string>>"


def test_catalog_matches(spark):
    lines = spark.createDataFrame([("d", 5, 4, "Daily Care"), ("d", 7, 0, "Daily Care"), ("d", 6, 2, "3 Daily Care"), ("d", 6, 3, "3 Daily Care"), ("d", 5, 0, "Daily Care Cleaning"), ("d", 5, 1, None), ("d", 5, 2, "Daily Care of it"), ("e", 5, 0, "Daily Care")], "doc string, page int, ix int, text string")
    catalog = spark.createDataFrame([("d", "daily care", 5), ("d", "cleaning", 6), ("d", None, 5)], "doc string, title string, page int")
    got = {(r.doc, r.page, r.ix): r.catalog_match for r in H.catalog_matches(lines, catalog).collect()}
    assert got == {("d", 5, 4): True, ("d", 7, 0): False, ("d", 6, 2): True, ("d", 6, 3): False, ("d", 5, 0): False, ("d", 5, 1): False, ("d", 5, 2): True, ("e", 5, 0): False}
    assert H.catalog_matches(lines, catalog.limit(0)).where("catalog_match").count() == 0


def test_sequences(spark):
    c = spark.createDataFrame([("d", 1, "I"), ("d", 3, "II"), ("d", 9, "III"), ("d", 1, "C"), ("d", 5, "V")], "doc string, page int, marker string")
    assert sorted(r.marker for r in H.roman_sequences(c).collect()) == ["I", "II"]
    c = spark.createDataFrame([("d", 1, "A"), ("d", 3, "B"), ("d", 9, "C"), ("d", 9, "D"), ("d", 20, "A"), ("d", 21, "A")], "doc string, page int, marker string")
    assert sorted((r.page, r.marker) for r in H.letter_sequences(c).collect()) == [(1, "A"), (3, "B")]


def test_cell_prefixes(spark):
    lines = spark.createDataFrame([("d", 1, "Check the"), ("d", 1, "check the pump"), ("d", 1, ""), ("d", 1, None), ("d", 2, "Check")], "doc string, page int, text string")
    tables = spark.createDataFrame([("d", 1, [["Check the pump", None], ["1", ""]])], f"doc string, page int, {ROWS}")
    assert [r.text for r in H.cell_prefixes(lines, tables).collect()] == ["Check the"]


def test_inferred(spark):
    lines = spark.createDataFrame([("d", p, p * 10) for p in range(1, 6)], "doc string, page int, ord int")
    accepted = spark.createDataFrame([("d", 1, 10, "One thing", True), ("d", 2, 20, "Two things", True)], "doc string, page int, ord int, text string, catalog_match boolean")
    titles = spark.createDataFrame([("d", 1, "One thing"), ("d", 3, "Three things"), ("d", 4, "Four"), ("d", 4, "And more"), ("d", 5, "FIVE"), ("e", 1, "Other thing")], "doc string, page int, title string")
    contents = spark.createDataFrame([], "doc string, ord int")
    assert sorted(tuple(r) for r in H.with_inferred(lines, accepted, titles, contents).collect()) == [("d", 1, 10, "One thing", False), ("d", 2, 20, "Two things", False), ("d", 3, 30, "Three things", True)]
    assert H.with_inferred(lines, accepted.limit(1), titles, contents).count() == 1


def test_row_matches(spark):
    cases = [("weight12kg", ["weight", "12", "kg"], True), ("theweightis12orsokg", ["weight", "12", "kg"], False), ("weightof12kg", ["weight", "12", "kg"], True), ("kg12weight", ["weight", "12", "kg"], False),
             ("abcdefghi", ["x", "abc", "def", "ghi", "longlonglong"], True), ("abcdef", ["x", "abc", "def", "ghi"], False), ("anoteofsometwentyletters", ["noteofsometwentyletters"], True),
             ("withmuchmoretextanoteofsometwentyletters", ["noteofsometwentyletters"], False), ("abcabc", ["abc", "abc"], True), ("abcx", ["abc", "abc"], False)]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, line string, cells array<string>, want boolean")
    got = d.select("i", "want", O.row_matches(F.col("line"), F.col("cells")).alias("got")).collect()
    assert [r.i for r in got if r.want != r.got] == []


def test_lines_beside_tables(spark):
    lines = spark.createDataFrame([("d", 1, "Weight of 12 kg"), ("d", 1, "Weight 12 kg"), ("d", 1, "12"), ("d", 2, "Weight 12 kg"), ("d", 1, None), (None, 1, "x")], "doc string, page int, line string")
    tables = spark.createDataFrame([("d", 1, [["Weight", "12", "kg", None]]), ("d", 1, None)], f"doc string, page int, {ROWS}")
    assert sorted((str(r.doc), r.page, str(r.line)) for r in O.lines_beside_tables(lines, tables).collect()) == [("None", 1, "x"), ("d", 1, "12"), ("d", 1, "None"), ("d", 2, "Weight 12 kg")]


def test_pages_with_tables(spark):
    pages = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "doc string, page int, text string")
    tables = spark.createDataFrame([("d", 1, 9.0, 0.0, [["low"]]), ("d", 1, 2.0, 5.0, [["right"]]), ("d", 1, 2.0, 1.0, [["left"]])], f"doc string, page int, top double, left double, {ROWS}")
    assert {r.page: [t.rows[0][0] for t in r.tables] for r in O.pages_with_tables(pages, tables).collect()} == {1: ["left", "right", "low"], 2: []}


def test_plan_rows(spark):
    row = '{"number": 1, "deviceName": "D", "maintenanceType": "T", "maintenanceWorkDescription": %s, "registrationNumber": %s, "frequency": "F"}'
    plans = [
        ("flat", '{"sections": [%s], "consumables": []}' % (row % ('"wipe"', '"NULL"'))),
        ("nested", '{"sections": [{"name": "S", "rows": [%s, %s]}], "consumables": []}' % (row % ('["a", "b"]', '"R1"'), row % ("[]", "null"))),
        ("bad", "no json"), ("null", None), ("none", '{"sections": [], "consumables": []}'), ("lacking", '{"sections": []}'), ("blank", '{"sections": [{"name": " ", "rows": [1]}], "consumables": []}'),
    ]
    found = P.plan_rows(spark.createDataFrame(plans, "plan string, json string")).collect()
    got = sorted(((r.plan, r.name, r.number, r.description, r.registrationNumber, r.valid) for r in found), key=str)
    want = [
        ("bad", None, None, None, None, False), ("blank", None, None, None, None, False), ("flat", P.FLAT_SECTION, "1", ["wipe"], None, True), ("lacking", None, None, None, None, False),
        ("nested", "S", "1", None, None, False), ("nested", "S", "1", ["a", "b"], "R1", True), ("null", None, None, None, None, False),
    ]
    assert got == sorted(want, key=str)
