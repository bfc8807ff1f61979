"""Selection, identity, headings, sections, chunks, assembly and answers on small fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lectern.functions.tokens import bpe_counter
from lectern.operators import assembly, chunker, detect, geometry, identity, noise, registry, selection, structure
from lectern.sinks import answers
from lectern.sources import models

LINES = "doc string, page int, ord long, ix int, text string"


def test_identity(spark):
    docs = spark.createDataFrame([("a", "Operating manual, Ventilux for clinics. ISO 13485. Page 12"), ("b", None), ("c", "no names here"), ("d", "Model AB-12TM and Model AB-12™")], "doc string, text string")
    got = {r.doc: r.name for r in identity.identities(docs).collect()}
    assert got == {"a": "Ventilux", "d": "Model AB-12"}
    late = spark.createDataFrame([("x", "w " * 5990 + "Model ZX-99 " + "w " * 100 + "Model ZX-11")], "doc string, text string")
    assert [r.name for r in identity.identity_candidates(late).collect()] == ["Model ZX-99"]  # beyond the first 12,000 characters nothing is read


def test_selection(spark):
    rows = [
        ("d", 1, ["Introduction"], "about"), ("d", 2, ["Maintenance"], "clean it weekly"), ("d", 3, ["Maintenance", "Parts"], "nothing"), ("d", 4, ["Maintenance", "Safety"], "care"), ("d", 5, ["Other"], "text"),
        ("e", 1, ["Contents"], "содержание"), ("e", 2, ["Other"], "no maintenance is needed"), ("f", 1, None, "preventive maintenance: replace"), ("f", 2, [], None),
    ]
    chunks = spark.createDataFrame(rows, "doc string, chunk_no long, path array<string>, content string")
    semantic = spark.createDataFrame([("d", 4), ("d", 5), ("e", 2)], "doc string, chunk_no long")
    got = {(r.doc, r.chunk_no): r.why for r in selection.select_chunks(chunks, semantic).collect()}
    assert got == {("d", 1): "first", ("d", 2): "score", ("d", 3): "score", ("d", 5): "search", ("e", 1): "fallback", ("f", 1): "score"}
    score = {(r.doc, r.chunk_no): r.score for r in selection.scored(chunks).collect()}
    assert score["d", 2] == 135 and score["d", 4] == -1000 and score["f", 1] == 45 and score["f", 2] == 0


def test_contents_pages_by_title(spark):
    entries = [f"Chapter of many words {k}" for k in range(4)]
    pages = {1: ["Contents", *entries], 2: entries, 3: ["a", "b", "c", "d", "e", "Contents", *entries], 4: [f"Part .... {k}" for k in range(4)]}
    lines = spark.createDataFrame([("d", p, p * 100 + k, t) for p, ls in pages.items() for k, t in enumerate(ls)], "doc string, page int, ord long, line string")
    assert {r.page for r in structure.contents_pages(lines).collect()} == {1, 4}


def test_contents_titles(spark):
    one = lambda t: [(r.title, r.page) for r in spark.createDataFrame([(t,)], "t string").select(F.explode(structure.contents_titles(F.col("t"))).alias("x")).select("x.*").collect()]
    assert one("1.2 First part ..... 3 II. Second …… 14") == [("1.2 First part ", 3), (" II. Second ", 14)]
    assert one("Third part  27 ") == [("Third part", 27)] and one("nothing") == [] and one("Open ... x 5") == [("Open ... x", 5)]
    clean = spark.createDataFrame([("1.2 First part ",), (" II. Second ",), ("A) Last__",)], "t string").select(structure.clean_title(F.col("t")).alias("t")).collect()
    assert [r.t for r in clean] == ["First part", "Second", "Last"]


def heads(spark, rows, catalog=(), contents=(), cells=None):
    lines = spark.createDataFrame([("d", p, k, i, t) for k, (p, i, t) in enumerate(rows)], LINES)
    c = spark.createDataFrame([("d", *x) for x in catalog], "doc string, title string, page int")
    found = detect.detect_headings(lines, c, spark.createDataFrame([("d", x) for x in contents], "doc string, ord long"), None if cells is None else spark.createDataFrame([("d", x) for x in cells], "doc string, ord long"))
    return {r.ord: (r.scheme, r.accepted) for r in found.collect()}


def test_heading_rules(spark):
    rows = [
        (1, 0, "1.1 First steps"), (1, 1, "1.2 Values of 5 mg"), (1, 2, "I. Roman one"), (2, 0, "II. Roman two"), (5, 0, "V. Alone"), (6, 0, "A. Letter a"), (6, 1, "B. Letter b"), (6, 9, "E. Too low on its page"),
        (7, 0, "GENERAL INFORMATION"), (7, 1, "TABLE 3 OF VALUES"), (7, 2, "SAFETY RULES"), (7, 3, "TO BE"), (8, 0, "Known title of the list"), (8, 1, "Known title elsewhere"), (8, 2, "2.1 A sentence that ends."), (8, 3, "• SAFETY RULES"), (8, 4, None), (8, 5, " "),
    ]
    got = heads(spark, rows, catalog=[("known title of the list", 9)])
    want = {0: ("DECIMAL", True), 1: ("DECIMAL", False), 2: ("ROMAN", True), 3: ("ROMAN", True), 4: ("ROMAN", False), 5: ("LETTER", True), 6: ("LETTER", True), 7: ("LETTER", False), 8: ("UPPERCASE", True), 10: ("UPPERCASE", False), 11: ("UPPERCASE", False), 12: ("TITLE_CASE", True), 14: ("DECIMAL", False)}
    assert got == want
    assert heads(spark, rows[:1] + [(2, 0, "1.3 Second steps")], contents=[1]) == {0: ("DECIMAL", True), 1: ("DECIMAL", False)}
    assert heads(spark, rows[:1] + [(2, 0, "1.3 Second steps")], cells=[0]) == {1: ("DECIMAL", False)}


def test_running_headers(spark):
    rows = [(p, i, t) for p in range(1, 5) for i, t in enumerate(["COMPANY PRODUCT HANDBOOK", f"{p}.1 Part of things", "plain text"])]
    got = heads(spark, rows)
    assert {v for v in got.values()} == {("DECIMAL", True)} and len(got) == 4  # the header is no candidate


def test_fold_sections(spark):
    rows = [
        (1, "1 ONE", "DECIMAL", False, False, False), (1, "text", None, False, False, False), (1, "1.1 Part", "DECIMAL", False, False, False), (1, "2.1 Other", "DECIMAL", False, False, False),
        (2, "2.1 Other", "DECIMAL", False, False, False), (3, "entry .... 4", None, False, False, True), (4, "SAFETY", "UPPERCASE", False, False, False), (4, "Safety", "TITLE_CASE", True, False, False),
    ]
    lines = spark.createDataFrame([("d", p, k, *x) for k, (p, *x) in enumerate(rows)], "doc string, page long, ord long, text string, scheme string, inferred boolean, repeated boolean, toc boolean")
    got = [(r.role, [h.text for h in r.path]) for r in structure.fold_sections(lines).orderBy("ord").collect()]
    assert got == [("heading", ["1 ONE"]), ("text", ["1 ONE"]), ("heading", ["1 ONE", "1.1 Part"]), ("heading", ["2.1 Other"]), ("dropped", ["2.1 Other"]), ("text", []), ("heading", ["SAFETY"]), ("text", ["SAFETY"])]


def test_split_first_counts_few_times():
    calls = []
    text = " ".join(f"word{i}." for i in range(4000))

    def fits(t):
        calls.append(1)
        return len(t.split()) <= 100

    head, rest = structure.split_first(text, fits)
    assert head + rest == text and len(head.split()) == 100 and len(calls) < 60


def test_nothing_is_dropped_where_nothing_fits(spark):
    blocks = spark.createDataFrame([("d", 1, "p", "abc"), ("d", 2, "p", "x")], "doc string, ord long, path string, text string")
    got = structure.pack_chunks(blocks, max_tokens=1, tokens=lambda t: 0 if t in ("", "x") else 5).collect()
    assert {(r.chunk_no, r.content, r.error) for r in got} == {(None, "abc", structure.TOO_SMALL), (1, "x", None)}


def test_pack_documents(spark):
    schema = "doc string, ord long, kind string, path array<struct<level:int,text:string>>, text string, rows array<array<string>>, n_header int, first_page int, last_page int"
    top, sub = [(1, "A")], [(1, "A"), (2, "B")]
    rows = [[f"cell{i}", "x"] for i in range(12)]
    blocks = [("d", 1, "text", None, "before", None, None, 1, 1), ("d", 2, "heading", top, None, None, None, 1, 1), ("d", 3, "heading", sub, None, None, None, 2, 2), ("d", 4, "text", sub, " ".join(f"w{i}" for i in range(30)), None, None, 2, 2), ("d", 5, "table", sub, None, rows, 1, 3, 4), ("d", 6, "heading", [(1, "C")], None, None, None, 5, 5)]
    got = chunker.pack_documents(spark.createDataFrame(blocks, schema), max_tokens=24).orderBy("chunk_no").collect()
    assert all(r.tokens <= 24 and r.error is None for r in got) and [r.chunk_no for r in got] == list(range(1, len(got) + 1))
    assert got[0].content == "before" and got[1].content.startswith("# A\n## B\n\nw0 w1") and got[-1].content == "# C" and (got[-1].first_page, got[-1].last_page) == (5, 5)
    body = " ".join(r.content for r in got)
    assert [w for w in body.split() if w.startswith("w") and w[1:].isdigit()] == [f"w{i}" for i in range(30)] and all(f"cell{i} " in body for i in range(12))


def test_assemble(spark):
    head = ["Name", "Amount"]
    rows = [("d", 1, 300.0, 50.0, 700.0, 550.0, [head, ["a", "1"]]), ("d", 2, 60.0, 90.0, 400.0, 590.0, [head, ["b", "2"]]), ("d", 3, 60.0, 50.0, 700.0, 550.0, [head, ["c", "3"]]), ("d", 5, 60.0, 50.0, 700.0, 550.0, [head, ["d", "4"]]), ("e", 1, 1.0, 1.0, 2.0, 2.0, None)]
    got = assembly.assemble(spark.createDataFrame(rows, "doc string, page int, top double, left double, bottom double, right double, rows array<array<string>>")).orderBy("doc", "table").collect()
    assert [(r.doc, r.table, r.fragments, r.first_page, r.last_page, [x.cells for x in r.rows]) for r in got] == [
        ("d", 1, 2, 1, 2, [head, ["a", "1"], ["b", "2"]]), ("d", 2, 1, 3, 3, [head, ["c", "3"]]), ("d", 3, 1, 5, 5, [head, ["d", "4"]]), ("e", 1, 1, 1, 1, []),
    ]


def test_suppress_in_documents_of_their_own(spark):
    rects = [("a", 1, 1, 0, 0, 10, 10, 5), ("a", 1, 2, 1, 1, 10, 10, 4), ("b", 1, 3, 0, 0, 10, 10, 1), ("a", 1, 4, 50, 50, 60, 60, 1)]
    df = spark.createDataFrame(rects, "doc string, page int, id int, t long, l long, b long, r long, q long")
    assert {r.id for r in geometry.suppress(df).collect()} == {1, 3, 4}
    assert [(r.doc, r.a, r.b) for r in geometry.overlaps(df).collect()] == [("a", 1, 2)]
    assert [(r.doc, r.a, r.b) for r in geometry.overlaps(df, cell=3).collect()] == [("a", 1, 2)]


def test_noise_profile(spark):
    marks = ["ab", "cd", "ef", "gh", "ij", "kl"]
    pages = spark.createDataFrame([("d", p, "\n".join(["Head of the page", f"text {p} at www.site.com/x and .org here", *marks, "kg", f"last {p}"])) for p in range(8)], "doc string, page long, text string")
    got = {(r.kind, r.value) for r in noise.noise_profile(pages).collect()}
    assert {("line", "head of the page"), ("inline", "www.site.com/x"), ("inline", ".org"), ("line", "ab")} <= got
    short = {r.line for r in noise.fragment_noise(pages).collect()}
    assert short == set(marks)


def test_registry_fallback_and_notices(spark):
    answers_ = [("q one", 1, "R 1", "something else", True), ("two", 2, "R2", "two a", True), ("two", 3, "R3", "two b", True), ("old", 4, " R  4 ", "old thing", False), ("olds", 5, "a", "x", False), ("olds", 6, "b", "y", False)]
    a = spark.createDataFrame(answers_, "query string, id long, registration string, name string, active boolean")
    q = spark.createDataFrame([(x,) for x in ("q one", "two", "old", "olds", "none", None)], "query string")
    got = {r["query"]: (r.status, r.registration) for r in registry.choose(q, a).collect()}
    assert got == {"q one": ("FOUND", "R 1"), "two": ("AMBIGUOUS", None), "old": ("EXPIRED", "R 4"), "olds": ("AMBIGUOUS", None), "none": ("NOT_FOUND", None), None: ("NOT_FOUND", None)}
    card = {r["query"]: r.card for r in registry.choose(q, a, "http://x").collect()}
    assert card["q one"] == "http://x/widget/med-product/1" and card["two"] is None


def test_answers_and_models(spark, tmp_path):
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a\r\n")], "doc string, page int, text string")
    assert json.loads(answers.text_answer(pages).first().json) == {"pageCount": 2, "pages": [{"pageNumber": 1, "text": "a"}, {"pageNumber": 2, "text": "b"}]}
    tables = spark.createDataFrame([("d", 1, 2, 3, [(["x", "y"], 2)])], "doc string, table long, first_page int, last_page int, rows array<struct<cells:array<string>,page:int>>")
    parsed = json.loads(answers.parsed_answer(pages, tables).first().json)
    assert [p["tables"] for p in parsed["pages"]] == [[], [{"tableNumber": 1, "endPage": 3, "rows": [["x", "y"]]}]]
    chunks = spark.createDataFrame([("d", 1, "p", "c", 2, None), ("d", None, "p", "x", 9, "too big")], "doc string, chunk_no long, path string, content string, tokens long, error string")
    assert json.loads(answers.chunk_answer(chunks).first().json)["chunkCount"] == 1
    answers.save(answers.text_answer(pages), str(tmp_path), "text")
    assert spark.read.json(str(tmp_path / "text")).count() == 1
    asked = spark.createDataFrame([("none",), (None,), (models.MODELS[0][0],)], "model string")
    assert {r.model: r.error for r in models.allowed(asked, models.models(spark)).collect()} == {"none": models.UNSUPPORTED, None: models.UNSUPPORTED, models.MODELS[0][0]: None}
    paths = spark.createDataFrame([("d", 1, [(1, "a"), (1, "b")]), ("d", 2, [(1, "a"), (3, "b")]), ("d", 3, []), ("d", 4, [(0, "a")])], "doc string, ord long, path array<struct<level:int,text:string>>")
    assert {r.ord for r in assembly.path_errors(paths).collect()} == {1, 4}


def test_bpe_counter(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    count = bpe_counter(path)
    assert 0 < count("a few plain words") <= 6 and count("") == 0
    blocks = spark.createDataFrame([("d", 1, "p", "some words " * 200)], "doc string, ord long, path string, text string")
    assert all(r.tokens <= 64 for r in structure.pack_chunks(blocks, 64, count).collect())
