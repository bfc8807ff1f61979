"""Tables put together from their fragments on pages, in reading order, and the quality by which candidates are chosen.

Fragments are (doc, page, top, left, bottom, right, rows): one rectangle of a page, its rows arrays of cells of one length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.geometry import continuation_islands

#: Fixed values, in points: how far the edges of two fragments of one table may differ, and how near the page break they must be.
TOLERANCE, TOLERANCE_SHARE, SHIFT_SHARE, LOWEST_BOTTOM, HIGHEST_TOP = 12.0, 0.05, 0.15, 500.0, 180.0
READING = ("page", "top", "left", "bottom", "right")


def has_labels(header: Column) -> Column:
    """At least two cells have three letters or more."""
    return F.size(F.filter(header, lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}]", "")) >= 3)) >= 2


def columns_of(rows: Column) -> Column:
    return F.coalesce(F.size(F.get(rows, 0)), F.lit(0))


def continues() -> Column:
    """Whether a fragment goes on with the table of the one before it, `prev` (see geometry.continuation_islands)."""
    f = lambda c, at="": F.col(f"prev.{c}") if at else F.col(c)
    width, before = f("right") - f("left"), f("right", "p") - f("left", "p")
    widest = F.greatest(width, before)
    tolerance = F.greatest(F.lit(TOLERANCE), widest * TOLERANCE_SHARE)
    shift = F.greatest(tolerance, widest * SHIFT_SHARE)
    header = F.get(f("rows"), 0)
    same = (header == F.get(f("rows", "p"), 0)) & has_labels(header) & (columns_of(f("rows")) == columns_of(f("rows", "p")))
    aligned = (F.abs(width - before) <= tolerance) & (F.abs(f("left") - f("left", "p")) <= shift) & (F.abs(f("right") - f("right", "p")) <= shift)
    return (f("page") - f("page", "p") == 1) & same & aligned & (f("bottom", "p") >= LOWEST_BOTTOM) & (f("top") <= HIGHEST_TOP)


def assemble(fragments: DataFrame) -> DataFrame:
    """(doc, table, fragments, first_page, last_page, top, left, rows): whole tables, numbered 1 .. n through each document in reading order.

    A fragment on the next page with the same header, place and width goes on with a table that ends low on its page. rows: array of
    (cells, page); of a fragment that goes on, a first row that equals the table's header of labels is left out. Equal places are in the
    order of the rows' text; a fragment without rows is a table without rows."""
    f = fragments.select("doc", *READING, F.coalesce("rows", F.array().cast("array<array<string>>")).alias("rows"))
    f = f.withColumn("tie", F.to_json("rows"))
    order = [*READING, "tie"]
    found = continuation_islands(f, "doc", order=order, continues=continues())
    inside = Window.partitionBy("doc", "island").orderBy(*order)
    header, number = F.get(F.first("rows").over(inside), 0), F.row_number().over(inside)
    marked = found.select("*", header.alias("header"), number.alias("number"))
    again = (F.col("number") > 1) & has_labels(F.col("header")) & F.coalesce(F.get("rows", 0) == F.col("header"), F.lit(False))
    kept = F.when(again, F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows"))
    rows = F.transform(kept, lambda r: F.struct(r.alias("cells"), F.col("page").alias("page")))
    parts = marked.select("doc", "island", F.struct("number", "page", "top", "left", rows.alias("rows")).alias("part"))
    whole = parts.groupBy("doc", "island").agg(F.array_sort(F.collect_list("part")).alias("ps"))
    first, last = F.get("ps", 0), F.element_at("ps", -1)
    out = whole.select("doc", "island", F.size("ps").alias("fragments"), first["page"].alias("first_page"), last["page"].alias("last_page"), first["top"].alias("top"), first["left"].alias("left"), F.flatten(F.transform("ps", lambda p: p["rows"])).alias("rows"))
    return out.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("first_page", "top", "left", "island")).cast("long").alias("table"), *out.columns[2:])


def candidate_quality(rows: Column, area: Column) -> Column:
    """(filled rows, whether all rows have as many cells, filled cells, area): the greater, the better."""
    filled = lambda r: F.size(F.filter(r, lambda c: F.coalesce(c.rlike(r"\S"), F.lit(False))))
    counts = F.transform(rows, filled)
    return F.struct(
        F.size(F.filter(counts, lambda n: n > 0)).alias("filled_rows"),
        (F.size(F.array_distinct(F.transform(rows, lambda r: F.size(r)))) <= 1).cast("int").alias("consistent"),
        F.aggregate(counts, F.lit(0), lambda a, n: a + n).alias("filled_cells"),
        area.alias("area"),
    )


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Append q: candidates of a page from the best (greatest q, 0) down, by quality, then in reading order; for geometry.suppress."""
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    place = F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.desc(candidate_quality(F.col("rows"), area)), "top", "left", "bottom", "right"))
    return candidates.withColumn("q", (1 - place).cast("long"))


def page_range(spans: Column) -> Column:
    """The least (first, last) that holds all of an array of page ranges."""
    return F.struct(F.array_min(F.transform(spans, lambda s: s["first"])).alias("first"), F.array_max(F.transform(spans, lambda s: s["last"])).alias("last"))


def fragment_errors(fragments: DataFrame) -> DataFrame:
    """(doc, page, error): fragments that can't be: pages from 1, finite places, some height and width, rows of one length, at least one."""
    numbers = [F.col(c).cast("double") for c in READING[1:]]
    finite = F.lit(True)
    for n in numbers:
        finite = finite & F.coalesce(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), F.lit(False))
    top, left, bottom, right = numbers
    widths = F.size(F.array_distinct(F.transform("rows", lambda r: F.size(r))))
    error = (
        F.when(F.coalesce(F.col("page") < 1, F.lit(True)), "page number")
        .when(~finite, "place that is no number")
        .when((bottom <= top) | (right <= left), "empty area")
        .when(F.coalesce(F.size("rows"), F.lit(0)) < 1, "no rows")
        .when(widths > 1, "rows of different lengths")
    )
    return fragments.select("doc", "page", error.alias("error")).where("error is not null")


def path_errors(paths: DataFrame) -> DataFrame:
    """(doc, ord, error): section paths (array of level and text) whose levels don't grow, or with a level under 1."""
    levels = F.transform("path", lambda h: h["level"])
    falls = F.exists(F.transform(levels, lambda x, i: (i > 0) & (x <= F.get(levels, F.greatest(i - 1, F.lit(0))))), lambda x: x)
    error = F.when(F.exists(levels, lambda x: x < 1), "level under 1").when(falls, "levels that don't grow")
    return paths.select("doc", "ord", error.alias("error")).where("error is not null")
