"""The device that a document is about: candidate names by pattern, weighted by how early and how often they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters of a text that are searched.
TITLE_LIMIT = 12_000
#: Patterns of names and the score of each occurrence, in their order.
PATTERNS = (
    (r"(?iu)\b(?:[a-zа-я]{3,}\s+)?[a-zа-я]{1,12}[- ]?\d{1,6}(?:[-/]?[a-zа-я0-9]+)*\b", 3),
    (r"(?<=[,«])\s*[A-Za-z]{5,}\b(?!\s+\d)", 20),
    (r"\b[A-Z][a-z]{3,}(?:\s+[A-Z][a-z]{3,}){1,2}\b", 4),
    (r"\b[A-Z]{3,}(?:\s+[A-Z]{2,}){1,2}\b", 1),
)
LEAST = 5


def clean_name(name: Column) -> Column:
    """Without trade marks, white space as single blanks, trimmed."""
    for pattern in ("[™®]", r"(?i)\bTM\b", r"(?i)TM(?=\s|$)"):
        name = F.regexp_replace(name, pattern, "")
    return F.btrim(F.regexp_replace(name, r"\s+", " "))


def identity_noise(name: Column) -> Column:
    """Page numbers, numbers of standards, dates, and what is too short."""
    low = F.lower(name)
    return (F.length(name) < LEAST) | low.rlike(r"^(?:page|seite|лист) \d+$") | low.rlike(r"^(?:iso|iec|en) ?\d+.*$") | low.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$")


def occurrences(text: Column, pattern: str, score: int, rank: int) -> Column:
    """Array of (name, score, first) for each match. Where a match begins follows from the lengths of what stands between the matches."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = lambda k: F.aggregate(F.slice(between, F.lit(1), k + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(found, lambda m, k: F.struct(clean_name(m).alias("name"), start(k).alias("start"), F.lit(score).alias("base"), F.lit(rank).alias("rank")))


def identity_candidates(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, name, score, occurrences, first): every name of a text's first TITLE_LIMIT characters that isn't noise.

    An occurrence counts its pattern's score and a point for each whole 100 characters that it stands before the 1,000th. `first`
    orders names by pattern, then place. A null text has none."""
    head = F.substring(F.col(text), 1, TITLE_LIMIT)
    lists = [occurrences(F.col("t"), pattern, score, rank) for rank, (pattern, score) in enumerate(PATTERNS)]
    found = docs.select(F.col(doc).alias("doc"), head.alias("t")).where("t is not null").select("doc", F.explode(F.concat(*lists)).alias("m")).select("doc", "m.*")
    kept = found.where(~identity_noise(F.col("name")))
    points = F.col("base") + F.floor(F.greatest(F.lit(0), 1000 - F.col("start")) / 100)
    return kept.groupBy("doc", "name").agg(F.sum(points).cast("long").alias("score"), F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("rank", "start")).alias("first"))


def identities(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, name, score): the name with the greatest score of each document, of equal ones the longest, then the first."""
    order = F.struct("score", F.length("name").alias("n"), (-F.col("first.rank")).alias("r"), (-F.col("first.start")).alias("s"))
    best = identity_candidates(docs, doc, text).groupBy("doc").agg(F.max_by(F.struct("name", "score"), order).alias("b"))
    return best.select("doc", "b.name", "b.score")
