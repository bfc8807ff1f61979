"""Heading candidates against the contents catalog, their neighbours, table cells, and headings inferred from the catalog.

Lines are (doc, page, ix, text): ix counts the lines of a page from 0. A catalog is (doc, title, page) with normalized titles
(functions.text.normalize_title). Band joins on pages are made equi joins by writing one side out for each page of the band, so
they shuffle on their keys like any other join; no pairs of a whole document or page are formed. Null texts and titles match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import compact, count_words, normalize_title, roman_value

#: Pages between a heading and its place in the catalog, first lines matched by affix, least title for that.
PAGE_DELTA, AFFIX_LINES, AFFIX_LEAST = 1, 3, 5
#: Fixed value: pages between headings of one sequence.
SEQUENCE_DELTA = 2


def _around(page: Column, delta: int) -> Column:
    return F.explode(F.sequence(page - F.lit(delta), page + F.lit(delta)))


def catalog_matches(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Append boolean `catalog_match`: the text is a catalog title of a page at most one away, or, in a page's first three lines,
    begins with such a title and a blank or ends with it; texts that are two such titles in a row match nothing. A column of that name gives way."""
    lines = lines.drop("catalog_match")
    near = catalog.where("title is not null and page is not null").select(F.col("doc").alias("__doc"), F.col("title").alias("__title"), _around(F.col("page"), PAGE_DELTA).alias("__at")).distinct()
    keys = lines.where("text is not null").select("doc", "page", "ix", normalize_title(F.col("text")).alias("__key")).distinct()
    here = (F.col("doc") == F.col("__doc")) & (F.col("page") == F.col("__at"))
    exact = keys.join(near, here & (F.col("__key") == F.col("__title")), "left_semi")
    affix = here & (F.startswith("__key", F.concat("__title", F.lit(" "))) | F.endswith("__key", F.col("__title")))
    partly = keys.where(F.col("ix") < AFFIX_LINES).join(near.where(F.length("__title") >= AFFIX_LEAST), affix, "left_semi")
    words, n = F.split("__key", " "), F.size(F.split("__key", " "))
    halves = keys.where(n >= 2).withColumn("__k", F.explode(F.sequence(F.lit(1), n - 1)))
    halves = halves.withColumns({"__a": F.array_join(F.slice(words, F.lit(1), F.col("__k")), " "), "__b": F.array_join(F.slice(words, F.col("__k") + 1, n - F.col("__k")), " ")})
    merged = halves.join(near, here & (F.col("__a") == F.col("__title")), "left_semi").join(near, here & (F.col("__b") == F.col("__title")), "left_semi")
    found = exact.unionByName(partly).distinct().join(merged.select("doc", "page", "ix", "__key").distinct(), ["doc", "page", "ix", "__key"], "left_anti")
    found = found.select(F.col("doc").alias("__doc"), F.col("page").alias("__page"), F.col("ix").alias("__ix"), F.col("__key").alias("__found"))
    same = (F.col("doc") == F.col("__doc")) & (F.col("page") == F.col("__page")) & (F.col("ix") == F.col("__ix")) & (normalize_title(F.col("text")) == F.col("__found"))
    return lines.join(found, same, "left").select(*lines.columns, F.col("__found").isNotNull().alias("catalog_match"))


def roman_sequences(candidates: DataFrame, marker: str = "marker") -> DataFrame:
    """The candidates (doc, page, marker, ..) for whose roman numeral the one before or after stands within two pages."""
    number = roman_value(F.col(marker))
    pairs = candidates.select(F.col("doc").alias("__doc"), number.alias("__n"), "page").distinct()
    near = pairs.select("__doc", F.explode(F.array(F.col("__n") - 1, F.col("__n") + 1)).alias("__n"), _around(F.col("page"), SEQUENCE_DELTA).alias("__at")).distinct()
    return candidates.join(near, (F.col("doc") == F.col("__doc")) & (F.col("page") == F.col("__at")) & (number == F.col("__n")), "left_semi")


def letter_sequences(candidates: DataFrame, marker: str = "marker") -> DataFrame:
    """The candidates whose letter and another one within two pages are different and one of them is A (of either script).

    Markers near a page are gathered as a set, which the alphabet bounds."""
    near = candidates.select(F.col("doc").alias("__doc"), F.col(marker).alias("__m"), _around(F.col("page"), SEQUENCE_DELTA).alias("__at")).groupBy("__doc", "__at").agg(F.collect_set("__m").alias("__set"))
    m = F.col(marker)
    first = lambda c: c.isin("A", "А")
    fits = F.exists("__set", lambda o: (o != m) & (first(o) | first(m)))
    joined = candidates.join(near, (F.col("doc") == F.col("__doc")) & (F.col("page") == F.col("__at")))
    return joined.where(fits).select(*candidates.columns)


def cell_prefixes(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """The lines (doc, page, text, ..) that begin a longer cell of a table (doc, page, rows) on their page; letters and digits count.

    Lines meet the cells that share their first letter or digit; distinct cells only."""
    cells = tables.select("doc", "page", F.explode("rows").alias("r")).select(F.col("doc").alias("__doc"), F.col("page").alias("__page"), F.explode("r").alias("c"))
    cells = cells.select("__doc", "__page", compact(F.col("c")).alias("__cell")).where("__cell <> ''").distinct()
    key = compact(F.col("text"))
    same = (F.col("doc") == F.col("__doc")) & (F.col("page") == F.col("__page")) & (F.substring(key, 1, 1) == F.substring("__cell", 1, 1))
    return lines.join(cells, same & (F.length("__cell") > F.length(key)) & F.startswith("__cell", key), "left_semi")


def title_case(text: Column) -> Column:
    """Begins with a letter, has a small letter, at most 12 words and 120 characters, and no mark at its end."""
    return F.coalesce(text.rlike(r"^\p{L}") & text.rlike(r"\p{Ll}") & (count_words(text) <= 12) & (F.length(text) <= 120) & ~text.rlike(r"[.!?,;:]$"), F.lit(False))


def reliable_title(title: Column) -> Column:
    """Title case, at most 100 characters, no number of several digits run into a word, and no new title after a small letter."""
    return title_case(title) & (F.length(title) <= 100) & ~title.rlike(r"\d{2,4}\p{L}") & ~title.rlike(r"\p{Ll}[\s\p{Z}]+\p{Lu}\p{Ll}{2,}")


def with_inferred(lines: DataFrame, accepted: DataFrame, titles: DataFrame, contents: DataFrame) -> DataFrame:
    """(doc, page, ord, text, inferred): accepted headings, and one for every page with exactly one title in the catalog, no accepted
    heading and a first line outside the contents, in documents with at least two headings that the catalog verifies.

    lines: (doc, page, ord); accepted: (doc, page, ord, text, catalog_match); titles: (doc, page, title as printed); contents: (doc, ord) of
    the contents' own lines. Sort by doc and ord where the order matters."""
    verified = accepted.groupBy("doc").agg(F.count_if("catalog_match").alias("n")).where("n >= 2").select("doc")
    single = titles.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("text")).where("n = 1").drop("n").where(reliable_title(F.col("text")))
    first = lines.groupBy("doc", "page").agg(F.min("ord").alias("ord"))
    found = single.join(verified, "doc", "left_semi").join(accepted, ["doc", "page"], "left_anti").join(first, ["doc", "page"]).join(contents, ["doc", "ord"], "left_anti")
    return accepted.select("doc", "page", "ord", "text", F.lit(False).alias("inferred")).unionByName(found.select("doc", "page", "ord", "text", F.lit(True).alias("inferred")))
