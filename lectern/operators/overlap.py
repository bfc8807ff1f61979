"""Text lines that repeat table rows, in full: equality, containment, cells in order, and runs of cells; tables beside their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import compact
from lectern.operators.tables import lines_outside_tables

#: Coverage of a line by one cell and by cells in order, least strong cell, least row of one cell, least run.
ONE_CELL, IN_ORDER, STRONG, LEAST_ROW, RUN = 0.90, 0.65, 3, 20, 3


def row_signature(row: Column) -> Column:
    """The row's cells as letters and digits, blank ones left out."""
    return F.filter(F.transform(row, lambda c: compact(F.coalesce(c, F.lit("")))), lambda c: c != "")


def usable(cells: Column) -> Column:
    """Two cells or 20 characters, and a cell of at least three."""
    return ((F.size(cells) >= 2) | (F.length(F.array_join(cells, "")) >= LEAST_ROW)) & F.exists(cells, lambda c: F.length(c) >= STRONG)


def row_matches(line: Column, cells: Column) -> Column:
    """Whether a compact line repeats a row's signature: it equals the whole row; it has the only cell and 90 % of the line is that;
    it has all cells in order and 65 % of it are those; or it is three or more neighbouring strong cells exactly."""
    n, whole = F.size(cells), F.array_join(cells, "")
    find = lambda c, at: F.call_function("locate", c, line, at)
    end = F.aggregate(cells, F.lit(1), lambda at, c: F.when((at > 0) & (find(c, at) > 0), find(c, at) + F.length(c)).otherwise(F.lit(0)))
    strong = lambda run: F.forall(run, lambda c: F.length(c) >= STRONG)
    equals = lambda run: (F.array_join(run, "") == line) & strong(run)
    runs = F.when(n >= RUN, F.exists(F.sequence(F.lit(1), n - RUN + 1), lambda at: F.exists(F.sequence(F.lit(RUN), n - at + 1), lambda k: equals(F.slice(cells, at, k)))))
    several = ((end > 0) & (F.length(whole) >= IN_ORDER * F.length(line))) | F.coalesce(runs, F.lit(False))
    one = F.contains(line, whole) & (F.length(whole) >= ONE_CELL * F.length(line))
    return (line == whole) | F.when(n == 1, one).otherwise(several)


def lines_beside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines (doc, page, line, ..) that repeat no row of their page's tables (doc, page, rows) and equal no longer cell.

    Equality goes first, as an anti join on the compact text. Of what is left, distinct lines meet the distinct rows of their page."""
    left = lines_outside_tables(lines, tables)
    rows = tables.select(F.col("doc").alias("__doc"), F.col("page").alias("__page"), F.explode("rows").alias("r")).select("__doc", "__page", row_signature(F.col("r")).alias("__cells")).distinct().where(usable(F.col("__cells")))
    keys = left.select("doc", "page", compact(F.col("line")).alias("__key")).where("__key <> ''").distinct()
    hit = keys.join(rows, (F.col("doc") == F.col("__doc")) & (F.col("page") == F.col("__page")) & row_matches(F.col("__key"), F.col("__cells")), "left_semi")
    hit = hit.select(F.col("doc").alias("__doc"), F.col("page").alias("__page"), "__key")
    return left.join(hit, left["doc"].eqNullSafe(hit["__doc"]) & left["page"].eqNullSafe(hit["__page"]) & (compact(left["line"]) == hit["__key"]), "left_anti")


def pages_with_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Append `tables`, the tables (doc, page, top, left, rows) that start on each page (doc, page, ..) in reading order; empty if there are none."""
    pages = pages.drop("tables")
    at = tables.groupBy(F.col("doc").alias("__doc"), F.col("page").alias("__page")).agg(F.array_sort(F.collect_list(F.struct("top", "left", "rows"))).alias("tables"))
    kind = at.schema["tables"].dataType
    joined = pages.join(at, (F.col("doc") == F.col("__doc")) & (F.col("page") == F.col("__page")), "left")
    return joined.select(*pages.columns, F.coalesce("tables", F.array().cast(kind)).alias("tables"))
