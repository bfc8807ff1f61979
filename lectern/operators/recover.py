"""Tables recovered from the rows of a table that a reader spread over a whole page: gaps and islands with windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_for_compare

#: Words of table headers.
TERMS = ["наименование", "значение", "количество", "параметр", "символ", "расшифровка", "изделия", "таблица", "name", "value", "quantity", "parameter", "symbol", "description", "table"]
#: Greatest height of a row, its greatest text if it has one cell, greatest gap between rows, least rows and width of a table, edge scraps.
HEIGHT, ONE_CELL_TEXT, GAP, ROWS, WIDTH, SCRAP, EDGE = 45.0, 240, 38.0, 3, 120.0, 3, 0.72


def likely_header(text: Column) -> Column:
    """Of a row's text in lower case: `table` in either language, two terms, or one and a number sign."""
    terms = reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in TERMS])
    return F.contains(text, F.lit("таблица")) | F.contains(text, F.lit("table")) | (terms >= 2) | ((terms >= 1) & (F.contains(text, F.lit("№")) | F.contains(text, F.lit("no "))))


def recover_tables(rows: DataFrame) -> DataFrame:
    """(doc, page, island, top, left, bottom, right, rows) from rows (doc, page, ix, top, bottom, page_right, cells of text, left, right).

    Rows that are blank go. A table ends at a row that is too high, a section heading or one long text, at a gap, and before a caption once it
    has a header; as a caption is a header itself, that is a running count within rows without another break. Kept are tables of three
    rows or more that are wide enough and have a header. Short cells at the page's right edge are blank and don't count for the width.
    Windows are by page; null cells count as blank."""
    scrap = lambda c: (F.length(F.btrim(c["text"])) <= SCRAP) & (c["left"] > EDGE * F.col("page_right"))
    filled = F.filter("cells", lambda c: F.coalesce(c["text"].rlike(r"\S"), F.lit(False)))
    wide = F.filter(filled, lambda c: ~F.coalesce(scrap(c), F.lit(False)))
    text = normalize_for_compare(F.array_join(F.transform(filled, lambda c: c["text"]), " "))
    d = rows.select(
        "doc", "page", "ix", "top", "bottom", F.size(filled).alias("n"), text.alias("text"),
        F.array_min(F.transform(wide, lambda c: c["left"])).alias("left"), F.array_max(F.transform(wide, lambda c: c["right"])).alias("right"),
        F.transform("cells", lambda c: F.when(F.coalesce(scrap(c), F.lit(False)), F.lit("")).otherwise(F.coalesce(F.btrim(c["text"]), F.lit("")))).alias("row"),
    ).where("n > 0")
    d = d.withColumn("header", likely_header(F.col("text")))
    heading = ~F.col("header") & F.col("text").rlike(r"^(\d+\.\s+.+|\d+(\.\d+)+\.?\s+.+)$")
    d = d.withColumn("good", (F.col("bottom") - F.col("top") <= HEIGHT) & ~heading & ((F.col("n") >= 2) | (F.length("text") <= ONE_CELL_TEXT)))
    w = Window.partitionBy("doc", "page").orderBy("ix")
    cut = ~F.col("good") | F.coalesce(~F.lag("good").over(w) | (F.col("top") - F.lag("bottom").over(w) > GAP), F.lit(True))
    d = d.withColumn("base", F.sum(cut.cast("int")).over(w)).where("good")
    inner = Window.partitionBy("doc", "page", "base").orderBy("ix")
    seen = F.coalesce(F.max("header").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    caption = F.col("text").rlike(r"\b(?:таблица|table)\s+\d+") | F.col("text").rlike(r"(?:^|[^\p{L}\p{N}_])таблица\s+\d+")
    d = d.withColumn("starts", (caption & seen).cast("int")).withColumn("part", F.sum("starts").over(inner))
    made = d.groupBy("doc", "page", "base", "part").agg(
        F.min("top").alias("top"), F.min("left").alias("left"), F.max("bottom").alias("bottom"), F.max("right").alias("right"), F.max("header").alias("header"),
        F.transform(F.array_sort(F.collect_list(F.struct("ix", "row"))), lambda r: r["row"]).alias("rows"),
    )
    made = made.where((F.size("rows") >= ROWS) & (F.col("right") - F.col("left") >= WIDTH) & F.col("header"))
    return made.select("doc", "page", F.row_number().over(Window.partitionBy("doc", "page").orderBy("base", "part")).alias("island"), "top", "left", "bottom", "right", "rows")
