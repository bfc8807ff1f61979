from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import noise, structure
from lectern.sources.html import html_to_text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def test_text_functions(spark):
    assert one(spark, "A  B​c ", T.normalize_for_compare) == "a bc"
    assert one(spark, "xiv", T.roman_value) == 14
    assert one(spark, "1.2.99999999999", T.decimal_number) == [1, 2, None]
    for json, want in (('"3"', [3]), ('["3", "5 – 7", 5]', [3, 5, 6, 7]), ('[[1], [2, ["4-4"]]]', [1, 2, 4]), ("7", [7])):
        assert one(spark, json, T.json_numbers) == want
    for json in ('"0"', '"page 3 of 5"', '"5-3"', '"1-200"', "[]", "{}", "1.5", "true", "null", None, "no json"):
        assert one(spark, json, T.json_numbers) is None
    assert one(spark, "007.010 x", T.leading_number) == "7.10" and one(spark, "x 1", T.leading_number) is None
    assert [one(spark, x, T.count_words) for x in ("a b", "(a) b", "", " - ")] == [2, 3, 1, 0]
    assert one(spark, "```json\n{}\n```", T.strip_fence) == "{}"
    assert one(spark, "a\r\n\r\n\r\n b ", T.normalize_page) == "a\n\nb"


def test_clean_pages_keeps_paragraphs(spark):
    pages = spark.createDataFrame([("d", 1, "first\n\nmark\nsecond\nthird"), ("d", 2, None)], "doc string, page long, text string")
    gone = spark.createDataFrame([("d", "mark")], "doc string, line string")
    got = {r.page: (r.n_in, r.n_out, r.cleaned) for r in noise.clean_pages(pages, gone).collect()}
    assert got == {1: (4, 3, "first\n\nsecond\nthird"), 2: (0, 0, "")}


def test_group_gate(spark):
    pages = spark.createDataFrame([("d", p, "yes") for p in range(10)], "doc string, page long, text string")
    assert noise.fragment_noise(pages).count() == 0


def test_fold_and_split():
    assert structure.fold_path([(1, "a"), (None, None), (2, "b"), (2, "c"), (1, "d")]) == [["a"], ["a"], ["a", "b"], ["a", "c"], ["d"]]
    head, rest = structure.split_first("One two. Three four.", lambda t: len(t.split()) <= 3)
    assert head + rest == "One two. Three four." and head == "One two. "


def test_chunks_stay_in_budget(spark):
    text = " ".join(f"w{i}." for i in range(500))
    got = structure.pack_chunks(spark.createDataFrame([("d", 1, "p", text), ("d", 2, "q", "end")], "doc string, ord long, path string, text string"), max_tokens=128).collect()
    assert all(r.tokens <= 128 for r in got)
    assert " ".join(r.content for r in sorted(got, key=lambda r: r.chunk_no)).split() == text.split() + ["end"]


def test_html():
    assert html_to_text("<div>a<br>b</div><p>c</p><script>x</script>") == "a\nb\nc\n"


def test_registry_lookup_contains(spark):
    from lectern.operators.registry import lookup

    names = [("Ventilator X200a", True), ("ventilator y", False), ("Pump Alpha", False), ("PUMP beta", False), ("scope q7", False), ("Лампа ЛМ-5", True), (None, True), ("lens pro", True), ("lens (pro) 2", True)]
    registry = spark.createDataFrame([(i, f"R{i}", n, a) for i, (n, a) in enumerate(names)], "id long, registration string, name string, active boolean")
    asked = ["vent x200", "X200", "vent", "pump", "pump al", "SCOPE", "q7", "q", "мпа лм", "lens pro", "none", "", None, "tor x2", "tor y"]

    def want(query):
        tokens = [t for t in "".join(c if c.isalnum() else " " for c in (query or "").lower()).split() if len(t) >= 2]
        hits = [(f"R{i}", a) for i, (n, a) in enumerate(names) if n and tokens and all(t in " ".join("".join(c if c.isalnum() else " " for c in n.lower()).split()) for t in tokens)]
        live = [r for r, a in hits if a]
        found = live or hits and [r for r, _ in hits]
        return ("NOT_FOUND", None) if not found else ("AMBIGUOUS", None) if len(found) > 1 else ("FOUND" if live else "EXPIRED", found[0])

    got = {r["query"]: (r.status, r.registration) for r in lookup(spark.createDataFrame([(x,) for x in [*asked, "pump"]], "query string"), registry).collect()}
    assert got == {x: want(x) for x in asked}
    assert got["vent"] == ("FOUND", "R0") and got["pump"] == ("AMBIGUOUS", None) and got["q7"] == ("EXPIRED", "R4")


def test_contrast_search_chooses_by_rounded_similarity(spark):
    from lectern.operators.retrieve import contrast_search

    items = spark.createDataFrame([(1, [0.5001, 0.0]), (2, [0.5004, 0.0]), (3, [0.6, 0.0]), (4, [0.4996, 0.0])], "id long, v array<double>")
    query, contrast = spark.createDataFrame([([1.0, 0.0],)], "v array<double>"), spark.createDataFrame([([0.0, 1.0],)], "v array<double>")
    found = lambda **how: [(r.id, r.sim) for r in contrast_search(items, query, contrast, 0.5, 0.1, 2, **how).collect()]
    assert found(digits=3) == [(3, 0.6), (1, 0.5)]  # 4 doesn't reach the threshold, though it rounds to it
    assert found() == [(3, 0.6), (2, 0.5004)]


def test_header_fingerprint_keeps_letters_apart(spark):
    from pyspark.sql import functions as F

    from lectern.functions.text import header_fingerprint

    want = {"Straße und 1 Haus": "STRAẞEUNDI", "ﬁne-ﬁlter 0815": "ﬁNEﬁLTEROI", "Fußgängerzone": "FUẞGÄNGERZ", "ßßßßß": None, "ᾳ big header": "ᾼBIGHEADER", "plain header line": "PLAINHEADE", None: None}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", header_fingerprint(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == want


def test_registry_lookup_counts_records_by_the_tokens_they_hold(spark):
    from lectern.operators import registry as R

    names = [f"Lens pro X{i}" for i in range(300)] + ["lens (PRO) x7", None, "", "pump 16", "Pump x163", "ПРОБА-ЛМ 5"]
    rows = [(i, f"R {i}", n, None if i % 50 == 7 else i % 3 > 0) for i, n in enumerate(names)] + [(3, "R 3", names[3], False)] * 2
    registry = spark.createDataFrame(rows, "id long, registration string, name string, active boolean")
    asked = spark.createDataFrame([(x,) for x in ["pro lens", "LENS pro q", "ens", "x7", "x299 lens", "pump 16", "pump 163", "лм проба", "16 none", "e", "", None, "x3 x3"]], "query string")
    wanted = spark.createDataFrame([("lens",), ("pro",), ("none",)], "token string")
    held = {(tuple(r.held), r.active): r.n for r in R._by_tokens(registry, wanted).collect()}
    live = sum(1 for _, _, n, a in rows if n and "lens" in n.lower() and a)
    assert held == {(("lens", "pro"), True): live, (("lens", "pro"), False): 303 - live}  # two rows stand for 303 records
    got = sorted(map(tuple, R.lookup(asked, registry, "b").collect()), key=str)
    assert got == sorted(map(tuple, R.choose(asked, R.search(asked, registry), "b").collect()), key=str) and len(got) == 13
    assert {r[0]: r[1] for r in got}["x299 lens"] == "FOUND"


def test_registry_lookup_sends_no_table_to_the_driver(spark):
    from lectern.operators import registry as R

    registry = spark.createDataFrame([(i, f"R {i}", f"Lens pro X{i}", i % 3 > 0) for i in range(300)], "id long, registration string, name string, active boolean")
    asked = spark.createDataFrame([("ens x299",), ("pro",), ("none",)], "query string")
    for found, n in ((R.lookup(asked, registry), 3), (R.search(asked, registry), 301)):
        assert len(found.collect()) == n
        plan = found._jdf.queryExecution().executedPlan().toString()  # the one that ran
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
