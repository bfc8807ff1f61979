"""Headings of documents: candidates by scheme, what a document's own lines say about them, and which are accepted.

Lines are (doc, page, ord, ix, text): ord is a line's place in the document, ix that in its page, both without gaps only where no line is
blank. catalog: (doc, title, page) of structure.contents_catalog; contents: (doc, ord) of the contents' own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import count_words, header_fingerprint, normalize_title, roman_value
from lectern.operators import headings, structure

#: Limits of titles that no catalog confirms.
MAX_NUMBER, MAX_WORDS, MAX_LENGTH, LAST_LINE = 99, 7, 80, 3
VALUE = r"(?iu)(?:\d|(?<![\p{L}\p{N}_])(?:mg|ml|kg|g|мг|мл|кг|г|мм|см|л|м|mmhg|hpa|hz|kw|mv|psi|кпа|дб|об)(?![\p{L}\p{N}_])|смh2o|об\.?%)"
MARKER = r"^[•–—+]+\s*"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that the optimizer doesn't write their expressions out wherever they are used."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("settled")).select(*df.columns, *[F.col("settled")[n].alias(n) for n in columns])


def short_letter_token(text: Column) -> Column:
    """Several words, one of which is a letter or two."""
    words = F.filter(F.split(F.btrim(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return (F.size(words) > 1) & F.exists(words, lambda w: (F.length(w) <= 2) & w.rlike(r"\p{L}"))


def standalone_title(words: Column, length: Column, ix: Column) -> Column:
    """One word of five characters or more among a page's first lines."""
    return (words == 1) & (length >= 5) & (ix <= 2)


def strong_style(title: Column) -> Column:
    """Mostly capitals, at most 12 words and 120 characters, no mark at the end."""
    upper, words = F.length(F.regexp_replace(title, r"[^\p{Lu}]", "")), count_words(title)
    return (_letters(title) > 0) & (10 * upper >= 7 * _letters(title)) & words.between(1, 12) & (F.length(title) <= 120) & ~title.rlike(r"[.!?,;:]$")


def value_like(title: Column) -> Column:
    """A digit, a unit, or nothing but one to three letters."""
    return title.rlike(VALUE) | title.rlike(r"(?iu)^[a-zа-яё]{1,3}$")


def page_headers(lines: DataFrame) -> DataFrame:
    """(doc, page, ord): the first two lines of pages that are repeated headers."""
    place = F.row_number().over(Window.partitionBy("doc", "page").orderBy("ord"))
    first = lines.where(F.col("text").rlike(r"\S")).withColumn("place", place).where("place <= 2").select("doc", "page", "ord", F.col("text").alias("line"))
    prints = first.withColumn("fingerprint", header_fingerprint(F.col("line")))
    return prints.join(structure.repeated_headers(first.select("doc", "page", "line")).select("doc", "fingerprint"), ["doc", "fingerprint"], "left_semi").select("doc", "page", "ord")


def dominant_headers(lines: DataFrame, headers: DataFrame, least: int = 3) -> DataFrame:
    """(doc): documents at least half of whose pages, and no fewer than `least`, have a repeated header."""
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("n"))
    return headers.groupBy("doc").agg(F.count_distinct("page").alias("k")).join(pages, "doc").where((F.col("k") >= least) & (2 * F.col("k") >= F.col("n"))).select("doc")


def candidates(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """(doc, page, ord, ix, text, scheme, title, marker, numbering, catalog_match): lines that may be headings.

    Without a scheme of its own, a line in title case is one of TITLE_CASE if the catalog has it."""
    trimmed = settled(lines.where(F.col("text").rlike(r"\S")).select("doc", "page", "ord", "ix", "text"), line=_trim(F.col("text"))).drop("text")
    schemed = settled(trimmed, scheme=structure.heading_scheme(F.col("line")))
    own, line = F.col("scheme"), F.col("line")
    by = lambda k: F.when(own == "DECIMAL", F.regexp_extract(line, structure.DECIMAL, k)).when(own == "ROMAN", F.regexp_extract(line, structure.ROMAN, k)).when(own == "LETTER", F.regexp_extract(line, structure.LETTER, k))
    titled = settled(schemed, text=F.coalesce(_trim(by(2)), line), marker=by(1))
    likely = settled(titled, likely=F.col("scheme").isNotNull() | headings.title_case(F.col("text"))).where("likely").drop("likely")
    matched = headings.catalog_matches(likely, catalog)
    scheme = F.coalesce("scheme", F.when(F.col("catalog_match"), "TITLE_CASE"))
    numbering = F.when(F.col("scheme") == "DECIMAL", F.transform(F.split("marker", r"\."), lambda x: x.try_cast("int")))
    return matched.select("doc", "page", "ord", "ix", F.col("line").alias("text"), scheme.alias("scheme"), F.col("text").alias("title"), "marker", numbering.alias("numbering"), "catalog_match").where("scheme is not null")


def text_counts(lines: DataFrame) -> DataFrame:
    """(doc, key, n): how often a normalized text stands in a document: as a line, behind a decimal number, behind a list mark."""
    text = _trim(F.col("text"))
    bare = F.regexp_replace(text, MARKER, "")
    forms = F.array_compact(F.array(text, F.when(text.rlike(structure.DECIMAL), F.regexp_extract(text, structure.DECIMAL, 2)), F.when(bare != text, bare)))
    return lines.where(F.col("text").rlike(r"\S")).select("doc", F.explode(forms).alias("t")).groupBy("doc", normalize_title(F.col("t")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def marker_labels(lines: DataFrame) -> DataFrame:
    """(doc, key): normalized texts behind a list mark."""
    text = _trim(F.col("text"))
    return lines.where(text.rlike(r"^[•–—+].+")).select("doc", normalize_title(F.regexp_replace(text, MARKER, "")).alias("key")).distinct()


def heading_profile(found: DataFrame) -> DataFrame:
    """(doc, decimals, level_one, depths, uppercase): what the candidates of a document are."""
    decimal = F.col("scheme") == "DECIMAL"
    return found.groupBy("doc").agg(F.count_if(decimal).alias("decimals"), F.count_if(decimal & (F.size("numbering") == 1)).alias("level_one"), F.array_sort(F.collect_set(F.when(decimal, F.size("numbering")))).alias("depths"), F.count_if(F.col("scheme") == "UPPERCASE").alias("uppercase"))


def detect_headings(lines: DataFrame, catalog: DataFrame, contents: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """candidates with `repeated` (the title stands more than once on its page) and `accepted`.

    cells: (doc, ord) of lines that begin a table cell. These, repeated page headers, and first lines in capitals where headers dominate are
    no candidates unless the catalog has them. A null text is no candidate."""
    own = lines.select("doc", "page", "ord", "ix", "text")
    found = candidates(own, catalog)
    headers = page_headers(own)
    first = own.where(F.col("text").rlike(r"\S")).groupBy("doc", "page").agg(F.min("ord").alias("ord")).join(dominant_headers(own, headers), "doc", "left_semi")
    numbered = F.col("text").rlike(r"^\d+(?:\.\d+)+[.)]?\s+\p{L}.*")
    out = headers.select("doc", "ord", F.lit("header").alias("why")).union(first.select("doc", "ord", F.lit("first")))
    if cells is not None:
        out = out.union(cells.select("doc", "ord", F.lit("cell")))
    out = out.groupBy("doc", "ord").agg(F.collect_set("why").alias("why"))
    why = lambda x: F.coalesce(F.array_contains("why", x), F.lit(False))
    dropped = why("cell") | (why("header") & ~numbered) | (why("first") & (F.col("scheme") == "UPPERCASE"))
    found = found.join(out, ["doc", "ord"], "left").where(F.col("catalog_match") | ~dropped).drop("why")
    found = found.withColumn("key", normalize_title(F.col("title"))).withColumn("repeated", F.count(F.lit(1)).over(Window.partitionBy("doc", "page", "key")) > 1)
    # what the document's candidates say together, in windows over the document: the candidates are found once
    whole, near = Window.partitionBy("doc"), Window.partitionBy("doc").orderBy("page").rangeBetween(-headings.SEQUENCE_DELTA, headings.SEQUENCE_DELTA)
    decimal, depth = F.col("scheme") == "DECIMAL", F.size("numbering")
    value = F.when(F.col("scheme") == "ROMAN", roman_value(F.col("marker")))
    letter = F.when(F.col("scheme") == "LETTER", F.col("marker"))
    found = found.withColumns(
        {
            "decimals": F.count_if(decimal).over(whole),
            "level_one": F.count_if(decimal & (depth == 1)).over(whole),
            "depths": F.collect_set(F.when(decimal, depth)).over(whole),
            "uppercase": F.count_if(F.col("scheme") == "UPPERCASE").over(whole),
            "values": F.collect_set(value).over(near),
            "letters": F.collect_set(letter).over(near),
        }
    )
    first_letter = lambda c: c.isin("A", "А")  # noqa: E731  of either script
    in_row = F.when(F.col("scheme") == "ROMAN", F.array_contains("values", value - 1) | F.array_contains("values", value + 1)).when(F.col("scheme") == "LETTER", F.exists("letters", lambda o: (o != F.col("marker")) & (first_letter(o) | first_letter(F.col("marker")))))
    found = found.withColumn("sequence", in_row).drop("values", "letters")
    toc = contents.select("doc", "ord").distinct().withColumn("toc", F.lit(True))
    said = text_counts(own).join(marker_labels(own).withColumn("label", F.lit(True)), ["doc", "key"], "left")
    c = found.join(said, ["doc", "key"], "left").join(toc, ["doc", "ord"], "left")
    return c.select("doc", "page", "ord", "ix", "text", "scheme", "title", "marker", "numbering", "catalog_match", "repeated", _accepted().alias("accepted"))


def _accepted() -> Column:
    title, scheme, match, ix = (F.col(x) for x in ("title", "scheme", "catalog_match", "ix"))
    words, length, times = count_words(title), F.length(title), F.coalesce("n", F.lit(0))
    true = lambda x: F.coalesce(x, F.lit(False))
    refused = true(F.col("toc")) | (length > 160) | (words > 20) | title.rlike(r"[.!?,;:]$") | ((scheme == "DECIMAL") & value_like(title) & ~match)
    refused = refused | ((scheme == "UPPERCASE") & true(F.col("label"))) | true((scheme == "DECIMAL") & (F.size("numbering") == 1) & (F.get("numbering", 0) == F.col("page")) & (times >= 2))
    short = F.get("numbering", 0).between(1, MAX_NUMBER) & (_letters(title) >= 3) & (words <= MAX_WORDS) & (length <= MAX_LENGTH) & title.rlike(r"^\p{Lu}")
    deep = F.when(F.size("numbering") >= 2, (F.col("decimals") >= 2) | strong_style(title)).otherwise(strong_style(title) & (F.col("level_one") >= 2))
    letter = (ix <= LAST_LINE) & (words <= MAX_WORDS) & (length <= MAX_LENGTH) & ~title.contains(":") & ~title.rlike(r"\p{Nd}") & true(F.col("sequence"))
    established = (F.col("decimals") >= 12) & F.array_contains("depths", 2)
    upper = ~established & (ix <= LAST_LINE) & ~short_letter_token(title) & strong_style(title) & (F.col("uppercase") >= 2) & ((words >= 2) | standalone_title(words, length, ix)) & ~((words <= 3) & (times >= 2))
    rule = F.when(scheme == "DECIMAL", short & deep).when(scheme == "ROMAN", true(F.col("sequence"))).when(scheme == "LETTER", letter).when(scheme == "UPPERCASE", upper).otherwise(F.lit(False))
    return ~refused & (match | true(rule))
