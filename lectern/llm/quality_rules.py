"""Quality rules, line first, in built-in SQL functions only.

Every line that has a word is judged by three rules: punctuation (too many marks for its letters, marks piled on the
ends of words, or shouting), navigation (separators between short labels) and boilerplate (stock phrases of pages).
Lines that fail are removed; a document that loses more than `max_lost` of its words' characters is rejected, and so
is one that fails the base rules on its whole text (fewer than 50 words, or over half of the words in repeated
3-word windows).

Characters of a kind are counted as what is left when runs of all others are taken out, not match by match.

Defined cases: a null text counts as an empty one (no words, base_failed, not kept, cleaned text null); lines without
a word are neither judged nor removed. Nothing but a document's own row is looked at, so that repeated rows, ties, other
columns (whatever their names) and the order of rows are without influence; an empty table gives an empty one. Texts of
any length are judged whole. Windows are compared by 64-bit hashes, kept whole at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import spare, table

WORD = r"[^\x20\x09-\x0D]+"
#: Share of a document's non-blank characters that may be lost with its failed lines.
MAX_LOST = 0.5
#: Fixed phrases of the boilerplate rule, in English, German, French and Spanish.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "accept cookies", "accept all cookies", "enable javascript", "subscribe to our", "sign up for", "click here", "skip to content", "skip to main content",
    "alle rechte vorbehalten", "cookies akzeptieren", "newsletter abonnieren", "zum inhalt springen", "tous droits réservés", "politique de confidentialité", "accepter les cookies", "cliquez ici",
    "todos los derechos reservados", "política de privacidad", "aceptar cookies", "aceptar las cookies", "haga clic aquí",
)
_PILED = r"[\p{L}\p{N}.,;:][!#*$%&|<>?]{2,}"


def _cols(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    return df.withColumns(named)


def _left(text: Column, pattern: str) -> Column:
    """Code points of text that are left without the runs that match: far fewer matches than one for each character."""
    return F.length(F.regexp_replace(text, pattern, ""))


def measured(line: Column) -> Column:
    """What the rules need of a line more than once; `signs` are its characters that are no letter, digit or blank."""
    return F.struct(
        line.alias("line"),
        F.regexp_count(line, F.lit(WORD)).alias("words"),
        F.regexp_replace(line, r"[\p{L}\p{N}\x20\x09-\x0D]+", "").alias("signs"),
        _left(line, r"[\x20\x09-\x0D]+").alias("visible"),
    )


def _stock(low: Column) -> Column:
    """Whether a line in lower case holds a stock phrase."""
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(low, F.lit(phrase))
    return found


def line_failure(m: Column) -> Column:
    """Which rule a measured line fails: punctuation, navigation or boilerplate; null if none."""
    line, words, marks, visible = m["line"], m["words"], F.length(m["signs"]), m["visible"]
    letters = _left(line, r"\P{L}+")
    upper = _left(line, r"\P{Lu}+")
    piled = F.regexp_count(line, F.lit(_PILED))
    separators = marks - F.length(F.translate(m["signs"], "|»›•>", ""))
    stock = F.exists(F.array(F.lower(line)), _stock)  # lower case once for all phrases
    return (
        F.when((10 * marks > 4 * visible) | ((words >= 5) & (10 * upper > 6 * letters) & (letters > 0)) | ((marks >= 6) & (piled >= 3) & (4 * piled >= words)), F.lit("punctuation"))
        .when((marks >= 3) & (separators >= 3) & (5 * separators >= words), F.lit("navigation"))
        .when((words <= 20) & stock, F.lit("boilerplate"))
    )


def quality_rules(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Append struct `rules`: the base counts, base_failed, lost (share of characters), clean_text, kept.

    A column of that name gives way to it; whatever else the columns are called, they are handed through.
    """
    names = [c for c in docs.columns if c != "rules"]
    t, w, l_, s, p, r, c, k, lost = spare(docs, "__t", "__w", "__l", "__s", "__p", "__r", "__c", "__k", "__lost")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(*names, text.alias(t), F.col(text_col).isNotNull().alias(s))
    d = _cols(d, {w: F.regexp_extract_all(F.col(t), F.lit(WORD), F.lit(0)), l_: F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(WORD))})
    there = spare(d, "__there")[0]
    d = d.withColumnRenamed(s, there)
    n = F.size(w)
    # most texts repeat no window: only the others' windows are sorted
    keys = F.transform(F.slice(F.col(w), F.lit(1), F.greatest(F.lit(0), n - 2)), lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)))
    d = _cols(d, {s: keys})
    pairs = F.transform(F.col(s), lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("i")))
    d = _cols(d, {s: F.when(F.size(F.array_distinct(s)) < F.size(s), F.sort_array(pairs)).otherwise(F.slice(pairs, 1, 0))})
    same = lambda v, j: F.coalesce(v["h"] == F.get(F.col(s), j)["h"], F.lit(False))
    twice = F.filter(s, lambda v, j: same(v, j + 1) | ((j > 0) & same(v, F.greatest(j - 1, F.lit(0)))))
    d = _cols(d, {p: F.sort_array(F.transform(twice, lambda v: v["i"]))})
    covered = F.aggregate(F.transform(p, lambda v, j: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get(F.col(p), j + 1), v + 3) - v)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    d = _cols(d, {r: covered, c: F.length(F.array_join(w, "")).cast("bigint")})
    d = _cols(d, {k: F.transform(l_, measured)})
    d = _cols(d, {k: F.filter(k, lambda m: line_failure(m).isNull())})
    kept_chars = F.aggregate(k, F.lit(0).cast("bigint"), lambda a, m: a + m["visible"])
    d = _cols(d, {lost: F.col(c) - kept_chars})
    base_failed = (n < 50) | (100 * F.col(r) > 50 * n)
    rules = F.struct(
        n.cast("bigint").alias("n_words"),
        F.col(c).alias("word_chars"),
        _left(F.col(t), "[^#*$%&|<>]+").cast("bigint").alias("n_symbols"),
        (F.size(l_) - F.size(F.array_distinct(l_))).cast("bigint").alias("n_dup_lines"),
        F.col(r).alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        F.col(lost).alias("lost_chars"),
        F.when(F.col(there), F.array_join(F.col(k)["line"], "\n")).alias("clean_text"),
        (~base_failed & (F.col(lost) <= max_lost * F.col(c))).alias("kept"),
    )
    return d.select(*[d[x] for x in names], rules.alias("rules"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rules")
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[r[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT g.r, unnest(range(g.i, g.i + 3)) AS j FROM g JOIN (SELECT r, s FROM g GROUP BY r, s HAVING count(*) > 1) k ON g.r = k.r AND g.s = k.s) GROUP BY r),
l AS (SELECT r, x FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM l GROUP BY r),
m AS (SELECT r, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS visible,
      len(regexp_extract_all(x, '[^\p{L}\p{N}\x20\x09-\x0D]')) AS marks, len(regexp_extract_all(x, '\p{L}')) AS letters, len(regexp_extract_all(x, '\p{Lu}')) AS upper,
      len(regexp_extract_all(x, '[\p{L}\p{N}.,;:][!#*$%&|<>?]{2,}')) AS piled, len(regexp_extract_all(x, '[|»›•>]')) AS seps FROM l),
lost AS (SELECT r, sum(visible) AS n FROM m
  WHERE (10 * marks > 4 * visible) OR (piled >= 3 AND 4 * piled >= words) OR (words >= 5 AND 10 * upper > 6 * letters AND letters > 0) OR (seps >= 3 AND 5 * seps >= words)
     OR (words <= 20 AND regexp_matches(x, '(?i)(cookie policy|privacy policy|terms of (use|service)|all rights reserved|accept (all )?cookies|enable javascript|subscribe to our|sign up for|click here|skip to (main )?content|alle rechte vorbehalten|cookies akzeptieren|newsletter abonnieren|zum inhalt springen|tous droits réservés|politique de confidentialité|accepter les cookies|cliquez ici|todos los derechos reservados|política de privacidad|aceptar (las )?cookies|haga clic aquí)')) GROUP BY r),
a AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0) AS lost
      FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * word_chars AS kept FROM a
"""
