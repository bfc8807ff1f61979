"""Repeated lines of documents: where they stand, how many pages have them, and which of them are noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_for_compare

HEADING = r"^\d+(\.\d+)*\.?\s+.+"


def lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, line_ix, raw, line, blank): all lines with their place, and normalized."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n", -1)
    exploded = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.posexplode(split).alias("line_ix", "raw"))
    return exploded.withColumn("line", normalize_for_compare(F.col("raw"))).withColumn("blank", F.col("line") == "")


def edge_lines(found: DataFrame, width: int = 3) -> DataFrame:
    """Lines that aren't blank, with edge: whether one is among the first or last few of its page."""
    page = Window.partitionBy("doc", "page")
    numbered = found.where(~F.col("blank")).withColumn("ix", F.row_number().over(page.orderBy("line_ix")) - 1).withColumn("n", F.count(F.lit(1)).over(page))
    return numbered.withColumn("edge", (F.col("ix") < width) | (F.col("ix") >= F.col("n") - width))


def page_lines(pages: DataFrame, doc: str, page: str, text: str, width: int = 3) -> DataFrame:
    """(doc, page, line, edge): as edge_lines of lines, but the places are found within each page's own row, without a shuffle. Rows that
    share a page are pages of their own."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n", -1)
    kept = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.filter(F.transform(split, normalize_for_compare), lambda x: x != "").alias("ls"))
    placed = F.transform("ls", lambda x, i: F.struct(x.alias("line"), ((i < width) | (i >= F.size("ls") - width)).alias("edge")))
    return kept.select("doc", "page", F.explode(placed).alias("x")).select("doc", "page", "x.line", "x.edge")


def safe_line(line: Column) -> Column:
    """Has a letter and is no numbered heading."""
    return line.rlike(r"\p{L}") & ~line.rlike(HEADING)


URL = r"(?iu)(https?://\S+|www\.\S+|(?<![\p{L}\p{N}_])[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.\p{L}{2,}(?:/\S*)?|(?<!\S)\.\p{L}{2,}(?![\p{L}\p{N}_]))"
#: Short lines that are values, not noise.
PROTECTED = ("да", "нет", "yes", "no", "on", "off", "мл", "мг", "мкг", "кг", "мм", "см", "мин", "сек", "ml", "mg", "mcg", "kg", "mm", "cm", "min", "sec")


def reliable_url(fragment: Column) -> Column:
    """Begins like a URL, is a top-level domain alone, or has four characters or more, a dot and an ASCII letter."""
    return fragment.rlike(r"^(https?://|www\.)") | fragment.rlike(r"^\.\p{L}{2,}$") | ((F.length(fragment) >= 4) & fragment.contains(".") & fragment.rlike("[a-zA-Z]"))


def inline_noise(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", ratio: float = 0.50, least: int = 3) -> DataFrame:
    """(doc, fragment, pages): URLs and domains within lines that are on enough pages of a document, to be cut out of the lines."""
    found = lines(pages, doc, page, text).where(~F.col("blank")).select("doc", "page", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(URL), F.lit(0)))).alias("fragment"))
    fragments = found.select("doc", "page", normalize_for_compare(F.col("fragment")).alias("fragment")).where(reliable_url(F.col("fragment")) & safe_line(F.col("fragment"))).distinct()
    counted = fragments.groupBy("doc", "fragment").agg(F.count(F.lit(1)).alias("pages"))
    need = F.greatest(F.lit(least), F.ceil(F.col("n_pages") * F.lit(ratio)))
    return counted.join(page_counts(pages, doc, page), "doc").where(F.col("pages") >= need).select("doc", "fragment", "pages")


def noise_profile(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", ratio: float = 0.35, fragment_ratio: float = 0.75, inline_ratio: float = 0.50, gate: int = 6) -> DataFrame:
    """(doc, kind, value), distinct: the noise of documents; kind `line` for whole lines, repeated or very short ones, `inline` for fragments."""
    whole = line_noise(pages, doc, page, text, ratio).select("doc", "line").union(fragment_noise(pages, doc, page, text, fragment_ratio, gate=gate).select("doc", "line")).distinct()
    inner = inline_noise(pages, doc, page, text, inline_ratio)
    return whole.select("doc", F.lit("line").alias("kind"), F.col("line").alias("value")).union(inner.select("doc", F.lit("inline"), "fragment"))


def line_frequency(found: DataFrame) -> DataFrame:
    """(doc, line, pages, edge_pages) of lines (doc, page, line, edge): each line of a page is counted once, in two aggregates on narrowing keys."""
    once = found.groupBy("doc", "line", "page").agg(F.max("edge").alias("edge"))
    return once.groupBy("doc", "line").agg(F.count(F.lit(1)).alias("pages"), F.count_if("edge").alias("edge_pages"))


def page_counts(pages: DataFrame, doc: str, page: str) -> DataFrame:
    return pages.groupBy(F.col(doc).alias("doc")).agg(F.count_distinct(page).alias("n_pages"))


def line_noise(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", ratio: float = 0.35, least: int = 3) -> DataFrame:
    """(doc, line, pages): lines on enough pages of a document, at their edges or holding a URL."""
    need = F.greatest(F.lit(least), F.ceil(F.col("n_pages") * F.lit(ratio)))
    counted = line_frequency(page_lines(pages, doc, page, text)).join(page_counts(pages, doc, page), "doc")
    return counted.where((F.col("pages") >= need) & ((F.col("edge_pages") >= need) | F.col("line").rlike(URL)) & safe_line(F.col("line"))).select("doc", "line", "pages")


def fragment_noise(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", ratio: float = 0.75, least: int = 3, gate: int = 6, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """Very short lines on most pages, taken only where a document has at least `gate` different ones."""
    line = F.col("line")
    short = (F.length(line).between(2, 7)) & line.rlike(r"\p{L}") & ~line.rlike(r"\p{N}") & ~line.rlike(HEADING)
    if protected:
        short = short & ~F.regexp_replace(line, r"\p{P}", "").isin(*protected)
    need = F.greatest(F.lit(least), F.ceil(F.col("n_pages") * F.lit(ratio)))
    counted = line_frequency(page_lines(pages, doc, page, text).where(short)).join(page_counts(pages, doc, page), "doc").where(F.col("pages") >= need)
    return counted.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("doc"))).where(F.col("k") >= gate).select("doc", "line", "pages")


def clean_pages(pages: DataFrame, noise: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, page, n_in, n_out, cleaned): pages without their document's noise lines; an empty line stays where one stood between kept lines."""
    found = lines(pages, doc, page, text)
    # blank lines, the most frequent of all, take no part in the join
    kept = found.where("not blank").join(noise.select("doc", "line"), ["doc", "line"], "left_anti").unionByName(found.where("blank"))
    after = F.sum(F.when(~F.col("blank"), 1).otherwise(0)).over(Window.partitionBy("doc", "page").orderBy("line_ix").rowsBetween(Window.unboundedPreceding, -1))
    grouped = kept.withColumn("g", F.coalesce(after, F.lit(0)))
    per_line = grouped.groupBy("doc", "page", "g").agg(F.max(F.struct("line_ix", F.when(~F.col("blank"), F.btrim(F.regexp_replace("raw", r"\s+", " "))).alias("t"))).alias("last"), F.max(F.col("blank").cast("int")).alias("gap"))
    joined = per_line.where("last.t is not null").groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("g", "gap", F.col("last.t").alias("t")))).alias("ls"))
    body = F.concat_ws("", F.transform("ls", lambda x, i: F.concat(F.when(i == 0, "").when(x["gap"] == 1, "\n\n").otherwise("\n"), x["t"])))
    sizes = found.groupBy("doc", "page").agg(F.sum(F.when(~F.col("blank"), 1).otherwise(0)).alias("n_in"))
    return sizes.join(joined, ["doc", "page"], "left").select("doc", "page", "n_in", F.coalesce(F.size("ls"), F.lit(0)).cast("long").alias("n_out"), F.coalesce(body, F.lit("")).alias("cleaned"))
