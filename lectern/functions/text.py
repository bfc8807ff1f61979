"""Column functions on text, numbers and vectors of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width characters and the byte order mark.
ZERO_WIDTH = "[​-‍﻿]"


def normalize_for_compare(text: Column) -> Column:
    """No-break spaces are spaces, zero-width characters go, runs of white space become one blank, trimmed, lower case."""
    t = F.regexp_replace(F.regexp_replace(text, " ", " "), ZERO_WIDTH, "")
    return F.lower(F.btrim(F.regexp_replace(t, r"\s+", " ")))


def normalize_line(text: Column) -> Column:
    """As normalize_for_compare, but soft hyphens go too and case stays."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "[­​-‍﻿]", ""), r"\s+", " "))


def fold(text: Column) -> Column:
    return F.translate(F.lower(normalize_line(text)), "ё", "е")


def normalize_page(text: Column) -> Column:
    """Text of a page: line ends are line feeds, no blanks around them, at most one empty line in a row, stripped."""
    t = F.regexp_replace(F.regexp_replace(text, " ", " "), "\r\n|\r|\f", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]*\n[ \t]*", "\n"), "\n{3,}", "\n\n")
    return F.btrim(t, F.lit(" \t\n"))


def compact_letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]", "")


def compact(text: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.translate(F.lower(text), "ё", "е"), r"[^\p{L}\p{N}]+", "")


def normalize_title(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, " ", " "), r"[\s\p{Z}]+", " ")
    return F.lower(F.btrim(F.regexp_replace(t, " */ *", "/")))


def count_words(text: Column) -> Column:
    """Runs of letters and digits; a separator before the first of them counts as one more, and a blank text has one."""
    t = F.btrim(text, F.lit(" \t\r\n"))
    n = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]+"))
    return F.when(F.length(t) == 0, 1).otherwise(n + F.when((n > 0) & t.rlike(r"^[^\p{L}\p{N}]"), 1).otherwise(0))


def leading_number(text: Column) -> Column:
    """The dotted number that a heading begins with, without leading zeros in its parts; null if there is none."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.array_join(F.transform(F.split(number, r"\."), lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")), "."))


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s+", ""))


def decimal_number(text: Column) -> Column:
    """`1.2.3` as an array; parts that don't fit an integer are null."""
    return F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))


def roman_value(text: Column) -> Column:
    """Value of a roman numeral; a smaller digit before a greater one is taken off."""
    digits = F.transform(F.regexp_extract_all(F.upper(text), F.lit("[IVXLCDM]"), F.lit(0)), lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in kv]), d))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    return F.aggregate(F.reverse(digits), start, lambda a, d: F.struct((a["sum"] + F.when(d < a["last"], -d).otherwise(d)).alias("sum"), F.greatest(d, a["last"]).alias("last")))["sum"]


#: Letters whose capital is not one letter of Unicode 15, and what upper_letters makes of them: the one letter that stands for the capital, or themselves.
_NO_CAPITAL = "ƛɤ" + "".join(c for c in map(chr, range(0x110000)) if len(c.upper()) > 1)
_CAPITAL = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _NO_CAPITAL)


def upper_letters(text: Column) -> Column:
    """Upper case letter by letter: no letter becomes two, so that ß is ẞ and not SS. For short texts."""
    one = lambda c: F.when(F.contains(F.lit(_NO_CAPITAL), c), F.translate(c, _NO_CAPITAL, _CAPITAL)).otherwise(F.upper(c))
    return F.when(text.rlike(f"[{_NO_CAPITAL}]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(F.upper(text))


def header_fingerprint(text: Column) -> Column:
    """The first ten letters in upper case, with digits that are read as letters; null if there are fewer."""
    t = F.substring(F.regexp_replace(text, r"[^\p{L}\x{345}015]", ""), 1, 10)  # U+0345 is no letter, but its capital is
    return F.when(F.length(t) >= 10, F.translate(upper_letters(t), "015", "OIS"))


def hamming(a: Column, b: Column, width: int = 10) -> Column:
    return sum([(F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int") for i in range(1, width + 1)], F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; of unit vectors, the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def embedding_excerpt(text: Column, whole: int = 420, head: int = 320, tail: int = 90) -> Column:
    return F.when(F.length(text) <= whole, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n…\n"), F.substring(text, -tail, tail)))


def path_markdown(path: Column) -> Column:
    """A section path (array of level and text) as headings, one a line."""
    return F.array_join(F.transform(path, lambda h: F.concat(F.repeat(F.lit("#"), F.least(h["level"], F.lit(6))), F.lit(" "), h["text"])), "\n")


def table_text(rows: Column) -> Column:
    """Rows of cells between [TABLE] marks; backslashes, bars and line ends in cells are escaped."""
    cell = lambda c: F.regexp_replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), "\r\n|\r|\n", "<br>")
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    return F.concat(F.lit("[TABLE]\n"), F.array_join(F.transform(rows, row), "\n"), F.lit("\n[/TABLE]"))


def strip_fence(text: Column) -> Column:
    """Without a Markdown fence around it."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"^```[^\n]*\n", ""), r"\n?```$", ""), F.lit(" \t\r\n"))


def positive_numbers(values: Column, span: int = 100) -> Column:
    """An array of texts, each a number or a range (`3-5`, any dash), as distinct positive integers in order.

    Null if there is none, or if one of them is anything else: other text around it, zero, a range that falls or is wider than span."""
    ends = F.transform(
        F.transform(values, lambda v: F.btrim(v, F.lit(" \t\r\n"))),
        lambda p: F.when(p.rlike(r"^\d+(\s*[-–—]\s*\d+)?$"), F.struct(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int").alias("a"), F.regexp_extract(p, r"(\d+)$", 1).try_cast("int").alias("b"))),
    )
    bad = F.exists(ends, lambda e: F.coalesce(e["a"].isNull() | e["b"].isNull() | (e["a"] < 1) | (e["b"] < e["a"]) | (e["b"] - e["a"] > span), F.lit(True)))
    numbers = F.array_distinct(F.flatten(F.transform(ends, lambda e: F.when((e["a"] >= 1) & (e["b"] >= e["a"]) & (e["b"] - e["a"] <= span), F.sequence(e["a"], e["b"])))))
    return F.when(~bad & (F.size(ends) > 0), numbers)


def json_numbers(json: Column, span: int = 100) -> Column:
    """positive_numbers of a JSON number, text, or array of these, nested up to three deep; null for anything else."""
    leaves = lambda v, deep: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: leaves(x, deep - 1))) if deep else F.array(F.lit("").cast("string"))).otherwise(F.array(F.when(F.schema_of_variant(v).isin("STRING", "BIGINT"), F.try_variant_get(v, "$", "string")).otherwise("")))
    return positive_numbers(leaves(F.try_parse_json(json), 3), span)


def registry_text(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def safe_date(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")
