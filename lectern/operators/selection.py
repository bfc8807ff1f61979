"""Choosing the chunks of a document that are about maintenance: lexicons, exclusion, section scopes, fallback.

Chunks are (doc, chunk_no, path, content): path is the array of headings above, chunk_no counts from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms are looked for as parts of lower-cased headings and contents.
MAINTENANCE = ("профилактическ", "техническое обслуживание", "техобслужив", "очистк", "дезинфек", "обработк", "maintenance", "cleaning", "disinfection", "preventive maintenance", "service intervals", "wartung", "reinig", "desinfiz", "sterilisation")
CONSUMABLES = ("расходн", "принадлежност", "аксессуар", "consumable", "supplies", "verbrauchsmaterial")
NEGATIVE = ("содержание", "безопасност", "предупрежден", "эксплуатац", "установк", "описание", "введение", "safety", "safe handling", "s a fe", "operating", "introduction", "introducing", "overview", "einführung", "übersicht")
SERVICE_ACTIONS = ("очист", "очищ", "дезинф", "стерилиз", "обработ", "провер", "замен", "смаз", "калибр", "inspect", "clean", "disinfect", "steriliz", "replace", "calibrat", "reinig", "desinfiz")
CARE_ACTIONS = ("очист", "очищ", "дезинф", "стерилиз", "обработ", "clean", "disinfect", "steriliz", "reinig", "desinfiz")
DIRECT_MAINTENANCE = ("техническое обслуживание", "техобслужив", "preventive maintenance", "technical maintenance", "service interval")
NEGATED_MAINTENANCE = ("не требует технического обслуживания", "no maintenance", "maintenance-free")
FREQUENCY = r"(?<![\p{L}\p{N}_])(?:ежеднев\p{L}*|еженедел\p{L}*|ежемесяч\p{L}*|ежегод\p{L}*|кажд\p{L}*|(?:час|месяц|год)\p{L}*|weekly|monthly|annually|every)(?![\p{L}\p{N}_])"
CONTENTS, LEADERS = "содержание", r"(?:\.\s*){6,}"
#: Points of a heading's and of a content's signals.
HEADING_POINTS, CONSUMABLE_POINTS, DIRECT_POINTS, CARE_POINTS, EXCLUDED = 100, 70, 45, 35, -1000


def matches(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms a text contains."""
    return sum([F.contains(text, F.lit(t)).cast("int") for t in terms], F.lit(0))


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def mentions_frequency(content: Column) -> Column:
    return content.rlike(FREQUENCY)


def is_contents(path: Column, content: Column) -> Column:
    """A table of contents: by its name in heading or content, or by a long row of dots; both are lower case."""
    return F.contains(content, F.lit(CONTENTS)) | F.contains(F.array_join(path, " "), F.lit(CONTENTS)) | content.rlike(LEADERS)


def excluded_by_headings(path: Column) -> Column:
    """Below the last negative heading there is none about maintenance."""
    last = F.array_max(F.transform(path, lambda h, i: F.when(has_any(h, NEGATIVE), i).otherwise(F.lit(-1))))
    below = F.slice(path, F.coalesce(last, F.lit(-1)) + 2, F.size(path))
    return (F.coalesce(last, F.lit(-1)) >= 0) & ~F.exists(below, lambda h: has_any(h, MAINTENANCE))


def scored(chunks: DataFrame) -> DataFrame:
    """(doc, chunk_no, path, contents, excluded, score): what each chunk has for it. A null content counts as empty, a null path as root."""
    low = F.transform(F.coalesce("path", F.array().cast("array<string>")), lambda h: F.lower(F.coalesce(h, F.lit(""))))
    c = chunks.select("doc", "chunk_no", F.coalesce("path", F.array().cast("array<string>")).alias("path"), low.alias("low"), F.lower(F.coalesce("content", F.lit(""))).alias("content"))
    content, path = F.col("content"), F.col("low")
    heads = F.concat(F.lit(" "), F.array_join(path, " "))
    c = c.select(
        "doc", "chunk_no", "path", is_contents(path, content).alias("contents"),
        (excluded_by_headings(path) | has_any(content, NEGATED_MAINTENANCE)).alias("negative"),
        matches(heads, MAINTENANCE).alias("m"), matches(heads, CONSUMABLES).alias("s"),
        (has_any(content, DIRECT_MAINTENANCE) & has_any(content, SERVICE_ACTIONS)).alias("direct"),
        has_any(content, CARE_ACTIONS).alias("care"), mentions_frequency(content).alias("often"),
    )
    signals = F.col("m") + F.col("s")
    cared = F.col("care") & ((signals > 0) | F.col("often"))
    points = HEADING_POINTS * F.col("m") + CONSUMABLE_POINTS * F.col("s") + DIRECT_POINTS * F.col("direct").cast("int") + CARE_POINTS * cared.cast("int")
    out = F.col("contents") | F.col("negative")
    score = F.when(out, EXCLUDED).when((signals > 0) | F.col("direct") | cared, points).otherwise(0)
    return c.select("doc", "chunk_no", "path", "contents", out.alias("excluded"), score.cast("int").alias("score"))


def scope(path: Column) -> Column:
    """A path up to its last heading about maintenance or consumables; null if it has none."""
    last = F.array_max(F.transform(path, lambda h, i: F.when(has_any(F.lower(h), MAINTENANCE + CONSUMABLES), i)))
    return F.when(last.isNotNull(), F.slice(path, F.lit(1), last + 1))


def select_chunks(chunks: DataFrame, semantic: DataFrame) -> DataFrame:
    """(doc, chunk_no, score, why): the chosen chunks of every document; semantic: (doc, chunk_no) that a search found.

    Chosen are those of the search that aren't excluded and those with a score; the chunks of the sections these are in, unless excluded;
    and chunk 1 unless the document begins with its contents. A document of which the first two choose nothing is represented by its
    first chunk alone, whatever it is. why: the first of search, score, section, first, fallback that holds."""
    s = scored(chunks)
    searched = s.join(semantic.select("doc", "chunk_no").distinct().withColumn("found", F.lit(True)), ["doc", "chunk_no"], "left")
    marked = searched.withColumn("why", F.when(F.coalesce("found", F.lit(False)) & ~F.col("excluded"), "search").when(F.col("score") > 0, "score"))
    scopes = marked.where("why is not null").select("doc", scope(F.col("path")).alias("prefix")).where("prefix is not null").distinct()
    prefixes = s.where("not excluded").select("doc", "chunk_no", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("prefix")).where(F.size("prefix") > 0)
    section = prefixes.join(scopes, ["doc", "prefix"], "left_semi").select("doc", "chunk_no").distinct().withColumn("section", F.lit(True))
    first = s.groupBy("doc").agg(F.min(F.struct("chunk_no", "contents")).alias("first"))
    some = marked.where("why is not null").select("doc").distinct().withColumn("some", F.lit(True))
    whole = marked.join(section, ["doc", "chunk_no"], "left").join(first, "doc").join(some, "doc", "left")
    why = F.coalesce(
        F.col("why"),
        F.when(F.col("section"), "section"),
        F.when(F.col("some") & (F.col("chunk_no") == 1) & ~F.col("first.contents"), "first"),
        F.when(F.col("some").isNull() & (F.col("chunk_no") == F.col("first.chunk_no")), "fallback"),
    )
    return whole.select("doc", "chunk_no", "score", why.alias("why")).where("why is not null")
