"""Contents pages, headings, repeated headers, section paths and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import count_words, hamming, header_fingerprint

DECIMAL = r"^\s*(\d+(?:\.\d+)*)(?:[.)]?\s+)(\p{L}.*)$"
ROMAN = r"^\s*([IVXLCDMivxlcdm]+)[.)]\s+(\p{L}.*)$"
LETTER = r"^\s*([A-ZА-ЯЁ])[.)]\s+(\p{L}.*)$"


def contents_entry(line: Column) -> Column:
    """A dot leader, or a page number at the end of at least three letters."""
    return line.rlike(r"\.{2,}|…{2,}") | (line.rlike(r"\s\d{1,4}\s*$") & (F.length(F.regexp_replace(line, r"[^\p{L}]", "")) >= 3))


LEADER = r"\.{2,}|…{2,}"
CONTENTS_TITLE = r"(?iu)^(?:содержание|оглавление|contents|table of contents|inhalt)$"
_NUMBERING = r"(?iu)^\s*(?:(?:\d+(?:\.\d+)*)|(?:[IVXLCDM]+)|(?:[A-ZА-ЯЁ]))[.)]?\s+"
_AT_END = r"^(.*?)[\s\p{Z}]+(\d{1,4})[\s\p{Z}]*$"


def contents_pages(lines: DataFrame, least: int = 4, leaders: int = 2, first: int = 5) -> DataFrame:
    """Pages (doc, page) of lines (doc, page, ord, line), blank ones left out, that are contents: enough entries, and either enough of
    them by dot leaders or a title of contents among the page's first lines."""
    line = F.col("line")
    title = F.when(F.regexp_replace(line, r"^[\x00-\x20]+|[\x00-\x20]+$", "").rlike(CONTENTS_TITLE), F.col("ord"))
    per = lines.groupBy("doc", "page").agg(F.count_if(contents_entry(line)).alias("entries"), F.count_if(line.rlike(LEADER)).alias("leaders"), F.min(title).alias("title"))
    likely = per.where((F.col("entries") >= least) & ((F.col("leaders") >= leaders) | F.col("title").isNotNull()))
    unsure = likely.where(F.col("leaders") < leaders)  # the title must be among the first lines
    before = lines.join(unsure.select("doc", "page", "title"), ["doc", "page"]).where("ord < title").groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= first)
    return likely.join(before.select("doc", "page"), ["doc", "page"], "left_anti").select("doc", "page", "entries", "leaders")


def clean_title(title: Column) -> Column:
    """A title of the contents without the number before it and the leaders behind it."""
    t = F.regexp_replace(title, "\u00a0", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, _NUMBERING, ""), r"[.\u2026\uFFFD_\s\p{Z}]+$", ""), r"[\s\p{Z}]+", " "))


def contents_titles(line: Column) -> Column:
    """Array of (title, page) that one line of the contents lists: those with leaders and a number behind them, one after the other; else,
    without any, the whole line up to a number at its end."""
    part = rf"\G((?:(?!{LEADER}).)*)(?:{LEADER})\s*(\d{{1,4}})"
    titles, pages = F.regexp_extract_all(line, F.lit(part), F.lit(1)), F.regexp_extract_all(line, F.lit(part), F.lit(2))
    led = F.zip_with(titles, pages, lambda t, n: F.struct(t.alias("title"), n.cast("int").alias("page")))
    whole = F.when(line.rlike(_AT_END), F.array(F.struct(F.regexp_extract(line, _AT_END, 1).alias("title"), F.regexp_extract(line, _AT_END, 2).cast("int").alias("page"))))
    return F.when(F.size(led) > 0, led).otherwise(whole)


def contents_entries(lines: DataFrame) -> DataFrame:
    """(doc, ord, printed, title, page): what the contents of documents list. lines: (doc, page, ord, line). printed is the title as it
    stands, title the normalized one; titles of fewer than three letters aren't listed."""
    entries = lines.join(contents_pages(lines).select("doc", "page"), ["doc", "page"], "left_semi").where(contents_entry(F.col("line")))
    listed = entries.select("doc", "ord", F.explode(contents_titles(F.col("line"))).alias("t")).select("doc", "ord", clean_title(F.col("t.title")).alias("printed"), F.col("t.page").alias("page"))
    title = F.regexp_replace(F.lower("printed"), " */ *", "/")
    return listed.withColumn("title", title).where(F.length(F.regexp_replace("title", r"[^\p{L}]", "")) >= 3).select("doc", "ord", "printed", "title", "page")


def contents_catalog(entries: DataFrame, least: int = 5) -> DataFrame:
    """(doc, title, page), distinct: the titles of contents_entries, and what stands behind the last slash of one, if long enough."""
    short = F.btrim(F.regexp_extract("title", r"/([^/]*)$", 1))
    both = F.array_compact(F.array(F.col("title"), F.when(F.length(short) >= least, short)))
    return entries.select("doc", F.explode(both).alias("title"), "page").distinct()


def heading_scheme(line: Column) -> Column:
    """DECIMAL, ROMAN, LETTER, UPPERCASE or null: the first that fits."""
    caption = line.rlike(r"(?iu)^\s*(?:рисунок|рис\.|figure|таблица|табл\.|table)\s+\d+")
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    return (
        F.when(line.rlike(DECIMAL) & ~line.rlike(r"^\s*\d+[)]\s+"), "DECIMAL")
        .when(line.rlike(ROMAN), "ROMAN")
        .when(line.rlike(LETTER), "LETTER")
        .when(line.rlike(r"^\p{L}") & (count_words(line) <= 12) & (F.length(line) <= 120) & (10 * upper >= 7 * letters) & ~caption, "UPPERCASE")
    )


def heading_level(scheme: Column, line: Column, nested: Column) -> Column:
    return F.when(scheme == "DECIMAL", F.size(F.split(F.regexp_extract(line, DECIMAL, 1), r"\."))).when(scheme.isin("LETTER", "TITLE_CASE"), F.when(nested, 2).otherwise(1)).when(scheme.isNotNull(), 1)


def repeated_headers(lines: DataFrame, pages: int = 3, distance: int = 2) -> DataFrame:
    """(doc, fingerprint): fingerprints of lines (doc, page, line) that, with those within a small Hamming distance, are on enough pages.

    Two fingerprints of ten letters that differ in at most two share one of three fixed parts; they are joined on the part.
    """
    prints = lines.select("doc", "page", header_fingerprint(F.col("line")).alias("f")).where("f is not null").distinct()
    parts = prints.select("doc", "page", "f", F.explode(F.array(F.concat(F.lit("1"), F.substring("f", 1, 3)), F.concat(F.lit("2"), F.substring("f", 4, 3)), F.concat(F.lit("3"), F.substring("f", 7, 4)))).alias("part"))
    kinds = parts.select("doc", "f", "part").distinct()
    near = kinds.alias("a").join(kinds.alias("b"), ["doc", "part"]).where(hamming(F.col("a.f"), F.col("b.f")) <= distance).select("doc", F.col("a.f").alias("f"), F.col("b.f").alias("g")).distinct()
    return near.join(prints.withColumnRenamed("f", "g"), ["doc", "g"]).groupBy("doc", "f").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= pages).select("doc", F.col("f").alias("fingerprint"), "pages")


def fold_path(rows: Iterable[tuple[int | None, str | None]]) -> list[list[str]]:
    """The path of headings above each row, from (level, heading) in order; rows without level are text."""
    path: list[tuple[int, str]] = []
    out = []
    for level, heading in rows:
        if level is not None:
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, heading or ""))
        out.append([h for _, h in path])
    return out


def section_paths(lines: DataFrame) -> DataFrame:
    """(doc, ord, path) from lines (doc, ord, level, heading); a document is folded in one task."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        levels = [None if pd.isna(x) else int(x) for x in frame["level"]]
        return pd.DataFrame({"doc": frame["doc"], "ord": frame["ord"], "path": fold_path(zip(levels, frame["heading"]))})

    return lines.select("doc", "ord", "level", "heading").groupBy("doc").applyInPandas(fold, "doc string, ord long, path array<string>")


def fold_sections(lines: DataFrame) -> DataFrame:
    """(doc, page, ord, role, path): the section of every line, and whether it is heading, text, both, or a repeated heading that is dropped.

    lines: (doc, page, ord, text, scheme, inferred, repeated, toc); scheme is null for text, repeated says that the title stands more than
    once on its page, toc that the line is an entry of the contents. path: array of (level, text). On a page with contents the path begins
    anew. A heading whose normalized text is on the path already (a decimal one: with the same number) is dropped, or text if it was
    inferred. A heading ends the path at its level, a decimal one also at the first heading above whose number isn't a part of its own.
    A document is folded in one task, in the order of ord."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        letters = int((frame["scheme"] == "LETTER").sum())
        anchors = int(((frame["scheme"] == "TITLE_CASE") & frame["repeated"].fillna(False).astype(bool)).sum()) >= 2
        contents = set(frame.loc[frame["toc"].fillna(False).astype(bool), "page"])
        path: list[tuple[int, str, str | None]] = []
        out, page = [], object()
        for row in frame.itertuples(index=False):
            if row.page != page:
                page = row.page
                path = [] if page in contents else path
            role = "text"
            if isinstance(row.scheme, str):
                number = section_number(row.text) if row.scheme == "DECIMAL" else None
                if any(plain_title(t) == plain_title(row.text) and (row.scheme != "DECIMAL" or n == number) for _, t, n in path):
                    role = "text" if row.inferred else "dropped"
                else:
                    nested = bool(path) and (letters >= 2 if row.scheme == "LETTER" else row.scheme == "TITLE_CASE" and anchors and not row.repeated)
                    level = number.count(".") + 1 if number else 2 if nested else 1
                    kept = []
                    for lvl, t, n in path:
                        if lvl >= level or (number and n is not None and not f"{number}.".startswith(f"{n}.")):
                            break
                        kept.append((lvl, t, n))
                    path = [*kept, (level, row.text, section_number(row.text))]
                    role = "both" if row.inferred else "heading"
            out.append((row.doc, row.page, row.ord, role, [{"level": lvl, "text": t} for lvl, t, _ in path]))
        return pd.DataFrame(out, columns=["doc", "page", "ord", "role", "path"])

    fields = ["doc", "page", "ord", "text", "scheme", "inferred", "repeated", "toc"]
    return lines.select(*fields).groupBy("doc").applyInPandas(fold, "doc string, page long, ord long, role string, path array<struct<level:int,text:string>>")


def section_number(text: str) -> str | None:
    """The dotted number that a heading begins with, without leading zeros."""
    import re

    found = re.match(r"\s*(\d+(?:\.\d+)*)", text or "")
    return ".".join(str(int(x)) for x in found.group(1).split(".")) if found else None


def plain_title(text: str) -> str:
    return " ".join((text or "").split()).lower()


def text_blocks(lines: DataFrame) -> DataFrame:
    """(doc, block, path, text, first_page, last_page): runs of lines (doc, page, ord, path, text, heading) under one path as one text each.

    A run ends at a heading, at another path and at the end of its page; headings are in no run. Lines are joined by a line feed, by two
    where a blank line stood between them; blank lines alone make no text."""
    order = Window.partitionBy("doc").orderBy("ord")
    before = F.lag(F.struct("page", "path", "heading")).over(order)
    new = F.when(before.isNull() | F.col("heading") | before["heading"] | (before["page"] != F.col("page")) | ~before["path"].eqNullSafe(F.col("path")), 1).otherwise(0)
    marked = lines.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not heading")
    blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    inside = Window.partitionBy("doc", "run").orderBy("ord")
    gaps = marked.withColumn("blank", blank).withColumn("gaps", F.sum(F.col("blank").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    kept = gaps.where("not blank")
    runs = kept.groupBy("doc", "run").agg(F.array_sort(F.collect_list(F.struct("ord", "gaps", F.btrim("text").alias("text")))).alias("ls"), F.first("path").alias("path"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    joined = F.concat_ws("", F.transform("ls", lambda x, i: F.concat(F.when(i == 0, "").when(x["gaps"] > F.get(F.col("ls"), i - 1)["gaps"], "\n\n").otherwise("\n"), x["text"])))
    return runs.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("run")).alias("block"), "path", joined.alias("text"), "first_page", "last_page")


def table_path(on_page: Column, before: Column, after: Column) -> Column:
    """The path of a page's tables: the common prefix of the different paths on the page; without any, of the paths before and after it."""
    paths = F.array_distinct(on_page)
    return F.when(F.size(paths) > 0, common_prefix(paths)).otherwise(common_prefix(F.array(before, after)))


def common_prefix(paths: Column) -> Column:
    """The longest common prefix of an array of paths."""
    first = F.get(paths, 0)
    n = F.aggregate(paths, F.size(first), lambda a, p: F.least(a, F.size(p)))
    steps = F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & F.forall(paths, lambda p: F.get(p, i) == F.get(first, i)))
    good = F.size(F.filter(F.transform(steps, lambda s, k: s == k), lambda x: x))
    return F.slice(first, F.lit(1), good)


def count_tokens(text: str) -> int:
    return len(text.split())


def split_first(text: str, fits: Callable[[str], bool]) -> tuple[str, str]:
    """The longest beginning that fits, cut at a paragraph, else a sentence, else a word, else a character; and the rest.

    Of each kind of cut the last that fits is found by halving, so that the counter runs a few times whatever the text's length; that
    a beginning of one that fits fits too is taken for granted."""
    import regex

    if fits(text):
        return text, ""

    def last(cuts: list[tuple[int, int]]) -> int:
        lo, hi = 0, len(cuts)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if fits(text[: cuts[mid - 1][0]]) else (lo, mid - 1)
        return cuts[lo - 1][1] if lo else 0

    for pattern in (r"\n\n+", r"(?<=[.!?…])\s+", r"\s+"):
        at = last([(m.start(), m.end()) for m in regex.finditer(pattern, text) if m.start()])
        if at:
            return text[:at], text[at:]
    at = last([(k, k) for k in range(1, len(text) + 1)])
    return text[:at], text[at:]


TOO_SMALL = "no character fits the budget"


def pack_chunks(blocks: DataFrame, max_tokens: int = 1200, tokens: Callable[[str], int] = count_tokens) -> DataFrame:
    """(doc, chunk_no, path, content, tokens, error): blocks (doc, ord, path, text) packed in order up to a token budget, one path a chunk.

    A block that doesn't fit is cut at the best place. Where not even a character fits, what is left of the block is a row of its own
    with `error`, without chunk_no, and the packing goes on with the next block.
    """

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        path, body, made = None, "", 0
        doc = frame["doc"].iloc[0]

        def flush() -> None:
            nonlocal body, made
            if body.strip():
                out.append((doc, made := made + 1, path, body.strip(), tokens(body.strip()), None))
            body = ""

        for row in frame.sort_values("ord").itertuples(index=False):
            if row.path != path:
                flush()
                path = row.path
            rest = row.text or ""
            while rest:
                prefix = body + "\n\n" if body else ""
                part, left = split_first(rest, lambda t, p=prefix: tokens(p + t) <= max_tokens)
                if part.strip() == "" and left:
                    if not body:
                        out.append((doc, None, path, rest, tokens(rest), TOO_SMALL))
                        break
                    flush()
                    continue
                body, rest = prefix + part, left
                if rest:
                    flush()
        flush()
        return pd.DataFrame(out, columns=["doc", "chunk_no", "path", "content", "tokens", "error"]).astype({"chunk_no": "Int64"})

    return blocks.select("doc", "ord", "path", "text").groupBy("doc").applyInPandas(pack, "doc string, chunk_no long, path string, content string, tokens long, error string")
