"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A test string is a window of
13 consecutive words of an item (a shorter item is one window), written as its words between single blanks, with
a blank at both ends; documents are written alike, so that a plain occurrence is one on word bounds.

Search: test strings are dealt into length classes. In a class, m is the least length; a table gives for each block of
B bytes how far the search may move on (0 where the block ends the first m bytes of a test string), blocks that occur
nowhere move it m - B + 1 bytes. Where the shift is 0, the bucket of that suffix block names the test strings, which
are told apart by their first bytes and confirmed by direct comparison.

Defined cases: null or wordless texts have no words and no hits and aren't contaminated. Items that are null or wordless
test nothing; repeated items with one id count once; a null item_id is the id ''. Whole texts are searched at any length. No
items or no documents: no hits, no rows. Overlapping and equal hits count a word once. Kept columns travel in one struct, so
that their names can't meet ours; one called contamination gives way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import discard, map_texts, materialize, table

WINDOW = 13
#: Test strings held by a task at a time; more are searched in further passes over the same rows.
PATTERNS_PER_PASS = 400_000
#: Least lengths of the classes.
CLASSES = (3, 16, 40)

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def windows(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))]


class _Class:
    """Tables of one length class."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.block = max(2, min(8, self.m // 2))
        self.default = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[bytes]]] = {}
        b, m = self.block, self.m
        for p in patterns:
            for end in range(b, m):
                key = p[end - b : end]
                if self.shift.get(key, self.default) > m - end:
                    self.shift[key] = m - end
            self.shift[p[m - b : m]] = 0
            self.bucket.setdefault(p[m - b : m], {}).setdefault(p[: m - b], []).append(p)

    def search(self, text: bytes, hits: list[tuple[int, bytes]]) -> None:
        pos, n, m, b = self.m, len(text), self.m, self.block
        default, shift = self.default, self.shift.get
        while pos <= n:
            move = shift(text[pos - b : pos], default)
            if move:
                pos += move
                continue
            start = pos - m
            for p in self.bucket[text[pos - b : pos]].get(text[start : pos - b], ()):
                if text.startswith(p, start):
                    hits.append((start, p))
            pos += 1


class WuManber:
    def __init__(self, patterns: list[bytes]):
        dealt: dict[int, list[bytes]] = {}
        for p in set(patterns):
            dealt.setdefault(max((c for c in CLASSES if c <= len(p)), default=0), []).append(p)
        self.classes = [_Class(v) for v in dealt.values()]

    def search(self, text: bytes) -> list[tuple[int, bytes]]:
        hits: list[tuple[int, bytes]] = []
        for c in self.classes:
            c.search(text, hits)
        return hits


_SEARCHERS: dict[str, WuManber] = {}


def _searcher(key: str, patterns: dict[bytes, list[str]]) -> WuManber:
    """The tables of one pass; a worker holds those of one at a time."""
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = WuManber(list(patterns))
    return _SEARCHERS[key]


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType().add("a", "long").add("b", "long"))), T.StructField("items", T.ArrayType(T.StringType()))])


def _scan(key: str, sent):
    def fn(texts: list[bytes | None]):
        patterns = sent.value
        search = _searcher(key, patterns).search if patterns else None
        counts, spans, items = [], [], []
        for text in texts:
            words = item_words(text)
            flat, found = [], set()
            if words and search:
                line = b" " + b" ".join(words) + b" "
                at = last = 0
                for start, p in sorted(search(line)):
                    at += line.count(b" ", last, start)
                    last = start
                    flat.append({"a": at, "b": at + p.count(b" ") - 1})
                    found.update(patterns[p])
            counts.append(len(words))
            spans.append(flat)
            items.append(sorted(found))
        return counts, spans, items

    return fn


def pattern_passes(items: DataFrame, item_id: str, item_text: str, width: int, most: int) -> Iterator[dict[bytes, list[str]]]:
    """Test strings with their item ids, `most` strings at a time; the items are read one by one, in the order of id and text."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).cast("string").alias("t")).orderBy("i", "t")
    held: dict[bytes, list[str]] = {}
    for row in rows.toLocalIterator():
        for p in windows(item_words(row.t.encode() if row.t is not None else None), width):
            if p not in held and len(held) >= most:
                yield held
                held = {}
            ids = held.setdefault(p, [])
            if row.i not in ids:
                ids.append(row.i)
    yield held


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, patterns_per_pass: int = PATTERNS_PER_PASS, keep: list[str] | None = None) -> DataFrame:
    """Append struct `contamination` (n_words, n_hit, spans of hit words as [from, to), item ids, contaminated) to docs.

    The test strings are searched in passes of patterns_per_pass. The driver holds those of one pass, and so does a task: what a
    pass found is written to the shared folder before the next begins.
    """
    spark = docs.sparkSession
    names = [c for c in (keep if keep is not None else docs.columns) if c != "contamination"]
    out = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*[docs[c] for c in names]).alias("given"))
    if not names:
        raise ValueError("at least one column must be kept")
    done, before = [], None
    for k, patterns in enumerate(pattern_passes(items, item_id, item_text, width, patterns_per_pass)):
        if k:
            written = materialize(out)
            if before is not None:
                discard(before)
            out = before = written
        done.append(f"found{k}")
        out = map_texts(out, "text", _scan(uuid.uuid4().hex, spark.sparkContext.broadcast(patterns)), _FOUND, out=done[-1])
    spans = F.array_sort(F.flatten(F.array(*[F.col(f"{c}.spans") for c in done])))
    state = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")), lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")))
    ids = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{c}.items") for c in done]))))
    out = out.withColumn("spans", spans).withColumn("hit", state["n"]).withColumn("ids", ids)
    words = F.col(f"{done[0]}.n_words")
    return out.select(
        *[F.col("given").getField(c).alias(c) for c in names],
        F.struct(words.alias("n_words"), F.col("hit").alias("n_hit"), F.col("spans").alias("spans"), F.col("ids").alias("items"), ((F.col("hit") > 0) & (20 * F.col("hit") >= words)).alias("contaminated")).alias("contamination"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    c = F.col("contamination")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), c["contaminated"].alias("contaminated"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item, least(13, len(ws)) AS width, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS s
      FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, k.width, array_to_string(ws[i:i + k.width - 1], ' ') AS s
       FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) d, (SELECT DISTINCT width FROM p) k WHERE i + k.width - 1 <= len(ws)),
h AS (SELECT dw.doc_id, dw.i, dw.width, p.item FROM dw JOIN p ON dw.s = p.s AND dw.width = p.width),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS j FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
