"""Noise removed from lines and table cells, as column functions over the noise profile of a document (two arrays of strings).

Null texts stay null; null and blank noise is passed over. Noise goes longest first, equal lengths in order of the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import compact_letters, normalize_for_compare, normalize_line

#: Short Latin words that cells need.
PROTECTED = ["no", "on", "off", "min", "max", "din", "dc", "ac", "vga", "usb", "rf", "id", "type", "name", "value", "ml", "mg", "mcg", "kg", "mm", "cm", "sec"]
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def _clean(noise: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(noise, F.array().cast("array<string>")), normalize_for_compare), lambda n: n.rlike(r"\S")))


def _longest(items: Column) -> Column:
    return F.transform(F.array_sort(F.transform(F.array_distinct(items), lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda x: x["n"])


def _fold(text: Column, items: Column, pattern: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit("(?iu)"), pattern(n)), F.lit(" ")))


def _words(noise: Column) -> Column:
    quoted = F.transform(F.split(noise, r"\s+"), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
    return F.array_join(quoted, r"\s+")


def _letters(noise: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(noise)), lambda i: F.substr(noise, i, F.lit(1))), r"[\s.]*")


def remove_inline_noise(text: Column, noise: Column) -> Column:
    """The line without any noise, whatever its case and white space; a bare ending such as `.org` goes only where it stands alone."""
    alone = lambda n: F.when(n.rlike(r"^\.[a-z]{2,}$"), F.concat(F.lit(r"(?<!\S)"), _words(n), F.lit(r"(?!\S)"))).otherwise(_words(n))
    return normalize_line(_fold(normalize_line(text), _longest(_clean(noise)), alone))


def clean_cell(text: Column, line_noise: Column, inline_noise: Column) -> Column:
    """A table cell without noise: empty if it is line noise or a part of some; else without inline noise, short line noise that stands alone,
    Latin noise of 3 to 8 letters and its 3-letter parts, the last two letters of noise glued to digits and, where noise has a domain, its scraps."""
    lines, inline = _clean(line_noise), _clean(inline_noise)
    noise = F.concat(lines, inline)
    domain = F.exists(noise, lambda n: n.rlike(r"[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}"))
    none = F.array().cast("array<string>")
    t = remove_inline_noise(text, inline_noise)
    is_noise = F.array_contains(lines, normalize_for_compare(t))

    tokens = F.filter(lines, lambda n: F.length(compact_letters(n)).between(3, 8) & ~n.rlike(r"\p{N}") & ~n.isin(PROTECTED))
    bounded = lambda body: lambda n: F.concat(F.lit(_BEFORE), body(n), F.lit(_AFTER))
    t = _fold(t, _longest(tokens), bounded(_words))

    latin = F.transform(noise, lambda n: F.regexp_replace(n, "[^a-z]", ""))
    short = F.filter(latin, lambda c: F.length(c).between(3, 8))
    parts = F.flatten(F.transform(short, lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3)))))
    latin_noise = F.filter(F.concat(short, parts, F.when(domain, F.array(F.lit("gov"))).otherwise(none)), lambda c: ~c.isin(PROTECTED))
    t = _fold(t, _longest(latin_noise), bounded(_letters))

    tails = F.concat(F.transform(F.filter(latin, lambda c: F.length(c) >= 4), lambda c: F.right(c, F.lit(2))), F.when(domain, F.array(F.lit("or"))).otherwise(none))
    t = _fold(t, F.filter(_longest(tails), lambda c: ~c.isin(PROTECTED)), lambda n: F.concat(F.lit(r"(?<=\d)"), _letters(n), F.lit(_AFTER)))

    scraps = F.regexp_replace(t, r"(?iu)" + _BEFORE + r"(?:or|gov)\." + _AFTER + r"|(?<!\S)\.[a-z](?!\S)", " ")
    scraps = F.regexp_replace(scraps, r"(?iu)" + _BEFORE + r"[a-z]{1,3}(?:\s+[a-z]{1,3}){1,3}" + _AFTER, " ")
    within = r"(?iu)(?<=\p{IsCyrillic})[a-z](?=\p{IsCyrillic})"
    scraps = F.when(F.regexp_count(scraps, F.lit(within)) >= 2, F.regexp_replace(scraps, within, "")).otherwise(scraps)
    t = normalize_line(F.when(domain, scraps).otherwise(t))

    left = compact_letters(normalize_for_compare(t))
    known = F.filter(F.transform(tokens, compact_letters), lambda n: F.length(n) >= 3)
    composed = F.length(left).between(3, 12) & F.exists(known, lambda n: F.contains(left, n) | F.contains(n, left))
    return F.when(text.isNotNull(), F.when(is_noise | composed, F.lit("")).otherwise(t))
