"""Tables as arrays of rows of cells: shape, quality, header rows, and text lines that repeat them.

All functions work on a column of type array<array<string>>. A null cell counts as a blank one, null rows count as none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import compact

#: Words that are frequent in header rows, found anywhere in a row's text.
HEADER_TERMS = ["таблица", "наименование", "значение", "количество", "параметр", "характеристика", "обозначение", "расшифровка", "описание", "код", "артикул", "единица",
                "table", "name", "value", "quantity", "parameter", "characteristic", "description", "code"]
#: Titles of contents pages.
CONTENTS_TITLES = ["содержание", "оглавление", "contents", "table of contents"]
_LEADER = r"\.{3,}\s*\d{1,4}([-–]\d{1,4})?"


def _filled(row: Column) -> Column:
    return F.filter(row, lambda c: c.rlike(r"\S"))


def _tokens(text: Column) -> Column:
    bare = F.transform(F.split(text, r"[\s|]+"), lambda t: F.regexp_replace(t, r"^\p{P}+|\p{P}+$", ""))
    return F.filter(bare, lambda t: t != "")


def _n_words(text: Column) -> Column:
    return F.size(F.filter(_tokens(text), lambda t: t.rlike(r"\p{L}")))


def _rest(cells: Column) -> Column:
    return F.array_join(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), " ")


def rectangular(rows: Column) -> Column:
    """Rows padded with empty cells to one width, without rows and columns that are blank throughout."""
    rows = F.filter(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.size(_filled(r)) > 0)
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    padded = F.transform(rows, lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.coalesce(c, F.lit(""))))
    used = lambda at: F.exists(rows, lambda r: F.coalesce(F.get(r, at).rlike(r"\S"), F.lit(False)))
    return F.transform(padded, lambda r: F.filter(r, lambda c, at: used(at)))


def is_candidate(rows: Column) -> Column:
    """At least two columns and two filled cells."""
    return (F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)) >= 2) & (F.size(F.flatten(F.transform(rows, _filled))) >= 2)


def _abbreviation(text: Column) -> Column:
    """2 to 8 letters, of which all but one, and two at least, are capitals."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return letters.between(2, 8) & (F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) >= F.greatest(F.lit(2), letters - 1))


def _row_features(cells: Column) -> Column:
    """What one row (its filled cells) adds to the metrics."""
    n, key, rest, text = F.size(cells), F.coalesce(F.get(cells, 0), F.lit("")), _rest(cells), F.lower(F.array_join(cells, " "))
    numeric = (n >= 2) & rest.rlike(r"\p{Nd}")
    last = F.lower(F.coalesce(F.regexp_extract(F.btrim(F.regexp_replace(key, r"[\s|]+", " ")), r"(\S*)$", 1), F.lit("")))
    listed = (n == 1) & (_n_words(key) >= 2) & F.regexp_replace(last, r"^\p{P}+|\p{P}+$", "").rlike(r"^(\d{1,4}|[ivxlcdm]{1,8})$")
    has = lambda terms: reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])
    return F.struct(
        n.alias("filled"),
        numeric.alias("numeric"),
        ((n >= 2) & (_n_words(key) <= 4) & (numeric | _abbreviation(key) | (_n_words(rest) >= 2))).alias("pair"),
        ((n == 1) & (_n_words(key) >= 7)).alias("sentence"),
        (F.exists(cells, lambda c: c.rlike(_LEADER)) | listed).alias("contents"),
        has(HEADER_TERMS).alias("terms"),
        has(CONTENTS_TITLES).alias("contents_title"),
        _tokens(F.array_join(cells, " ")).alias("tokens"),
    )


def table_quality(tables: DataFrame, rows_col: str = "rows") -> DataFrame:
    """Append struct `quality`: metrics, score, reason (of the first rule that rejects, null if kept) and kept.

    Expects rectangular rows (see rectangular). A table without rows is rejected as `no words`; an input column `quality` gives way.
    """
    names = [c for c in tables.columns if c != "quality"]
    d = tables.select(*names, F.transform(F.coalesce(F.col(rows_col), F.array().cast("array<array<string>>")), lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))).alias("__g"))
    d = d.withColumn("__f", F.transform("__g", _filled))
    d = d.withColumn("__x", F.transform("__f", _row_features))
    tokens = F.flatten(F.transform("__x", lambda x: x["tokens"]))
    d = d.withColumns({"__t": tokens, "__all": F.array_join(F.flatten("__g"), "")})
    count = lambda field: F.size(F.filter("__x", lambda x: x[field]))
    n_rows, n_cols = F.size("__g"), F.coalesce(F.size(F.get("__g", 0)), F.lit(0))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    d = d.withColumn(
        "__q",
        F.struct(
            n_rows.alias("n_rows"),
            F.greatest(n_cols, F.lit(0)).alias("n_cols"),
            F.size(F.flatten("__f")).alias("filled"),
            F.size("__t").alias("n_tokens"),
            F.size(F.filter("__t", lambda t: F.length(t) == 1)).alias("single"),
            F.size(F.filter("__t", lambda t: (F.length(t) >= 3) & t.rlike(r"\p{L}"))).alias("words"),
            F.size(F.filter("__x", lambda x: x["filled"] >= 2)).alias("multi"),
            count("pair").alias("pairs"),
            count("numeric").alias("numeric"),
            count("sentence").alias("sentences"),
            count("contents").alias("contents"),
            F.exists("__x", lambda x: x["terms"]).alias("terms"),
            F.exists("__x", lambda x: x["contents_title"]).alias("contents_title"),
            F.length(F.regexp_replace("__all", r"\s+", "")).alias("visible"),
            F.length(F.regexp_replace("__all", r"[^\p{L}\p{Nd}]", "")).alias("alnum"),
        ),
    )
    q = F.col("__q")
    single, multi, sentences = share(q["single"], q["n_tokens"]), share(q["multi"], q["n_rows"]), share(q["sentences"], q["n_rows"])
    contents = q["contents_title"] | (share(q["contents"], q["n_rows"]) >= 0.45)
    points = lambda condition, n: F.when(condition, F.lit(n)).otherwise(F.lit(0))
    score = sum(
        [
            points(q["n_rows"] >= 2, 1), points(q["n_rows"] >= 3, 1), points(q["n_cols"] >= 2, 1), points(multi >= 0.45, 2), points(q["pairs"] >= 2, 2), points(q["pairs"] == 1, 1),
            points(q["numeric"] > 0, 1), points(q["words"] >= 4, 1), points(single > 0.5, -3), points((sentences > 0.6) & (q["pairs"] < 2) & ~q["terms"], -2), points(contents, -4),
            points((multi < 0.45) & ~q["terms"], -2),
        ],
        points(q["terms"], 3),
    )
    d = d.withColumns({"__score": score, "__contents": contents, "__single": single, "__multi": multi})
    below = lambda at: F.size(F.filter(F.slice(F.col("__g"), F.lit(2), F.greatest(n_rows - 1, F.lit(0))), lambda r: F.get(r, at).rlike(r"\S")))
    unsupported = (n_rows >= 2) & F.exists(
        F.transform(F.get("__g", 0), lambda c, at: F.struct(c.rlike(r"\S").alias("label"), below(at).alias("data"))),
        lambda c: (c["label"] & (c["data"] == 0)) | (~c["label"] & (F.col("__q.n_rows") >= 3) & (c["data"] <= 1)),
    )
    first = F.get("__f", 0)
    strong = (F.size(first) == q["n_cols"]) & (F.size(F.array_distinct(first)) == F.size(first)) & (F.length(F.regexp_replace(F.get(first, 0), r"[^\p{L}]", "")) >= 3) & (q["numeric"] > 0)
    wide, pairs = q["n_cols"] >= 2, q["pairs"]
    reason = (
        F.when((q["visible"] >= 60) & (q["alnum"] < 0.6 * q["visible"]), F.lit("corrupted text"))
        .when(q["words"] == 0, F.lit("no words"))
        .when((q["n_rows"] <= 2) & (F.col("__single") > 0.5) & ~q["terms"] & (pairs == 0), F.lit("small and noisy"))
        .when(F.col("__contents"), F.lit("contents"))
        .when(wide & (q["multi"] == 0), F.lit("no row of several cells"))
        .when(wide & (q["n_rows"] >= 3) & (F.col("__multi") < 0.25) & (pairs < 2), F.lit("few rows of several cells"))
        .when((q["n_cols"] == 2) & (q["n_rows"] >= 3) & q["terms"] & (q["multi"] == 1) & (pairs < 2), F.lit("header only"))
        .when((q["n_cols"] >= 3) & (q["n_rows"] >= 2) & (q["filled"] < 0.6 * q["n_rows"] * q["n_cols"]), F.lit("sparse"))
        .when(unsupported, F.lit("column without data"))
        .when(q["n_cols"] == 1, F.lit("one column"))
        .when((q["n_rows"] == 1) & ~F.coalesce(strong, F.lit(False)), F.lit("weak single row"))
        .when((q["n_rows"] > 1) & (F.col("__score") < 3) & ~((pairs >= 2) & (q["words"] >= 4) & (F.col("__single") <= 0.5)), F.lit("low score"))
    )
    d = d.withColumn("__reason", reason)
    made = F.struct(*[q[c].alias(c) for c in ("n_rows", "n_cols", "filled", "n_tokens", "words", "multi", "pairs", "numeric", "sentences", "contents")], F.col("__score").alias("score"), F.col("__reason").alias("reason"), F.col("__reason").isNull().alias("kept"))
    return d.select(*names, made.alias("quality"))


def header_rows(rows: Column, most: int = 3, after: int = 2) -> Column:
    """How many of the first rows are a header: the greatest number, up to `most`, that leaves `after` rows of data and whose cells
    are labels unlike the data (enough digits below, or another mean length of cells). 0 if there is none, or no rows."""
    n = F.size(rows)

    def fits(k: int) -> Column:
        head, data = F.flatten(F.slice(rows, 1, k)), F.flatten(F.slice(rows, F.lit(k + 1), F.greatest(n - k, F.lit(0))))
        share = lambda cells, pattern: F.size(F.filter(cells, lambda c: c.rlike(pattern))) / F.greatest(F.size(cells), F.lit(1))
        mean = lambda cells: F.aggregate(cells, F.lit(0), lambda s, c: s + F.coalesce(F.length(c), F.lit(0))) / F.greatest(F.size(cells), F.lit(1))
        labels = F.size(F.filter(head, lambda c: c.rlike(r"\p{L}")))
        return (n >= k + after) & (labels >= 2) & (share(head, r"\p{L}") >= 0.5) & ((share(data, r"\p{Nd}") >= 0.2) | (F.abs(mean(head) - mean(data)) >= 2.0))

    return F.coalesce(*[F.when(fits(k), F.lit(k)) for k in range(most, 0, -1)], F.lit(0))


def lines_outside_tables(lines: DataFrame, tables: DataFrame, least: int = 6) -> DataFrame:
    """Lines (doc, page, line, ..) that equal no row of their page's tables (doc, page, rows), and no cell of at least `least`
    letters and digits with a letter among them; case, blanks and marks don't count. Lines without letters or digits stay."""
    rows = tables.select("doc", "page", F.explode("rows").alias("r"))
    whole = rows.select("doc", "page", compact(F.array_join("r", "")).alias("key"))
    cells = rows.select("doc", "page", F.explode("r").alias("c")).select("doc", "page", compact(F.col("c")).alias("key")).where((F.length("key") >= least) & F.col("key").rlike(r"\p{L}"))
    known = whole.unionByName(cells).where("key <> ''").select(F.col("doc").alias("__doc"), F.col("page").alias("__page"), F.col("key").alias("__key")).distinct()
    same = lines["doc"].eqNullSafe(known["__doc"]) & lines["page"].eqNullSafe(known["__page"]) & (compact(lines["line"]) == known["__key"])
    return lines.join(known, same, "left_anti")
