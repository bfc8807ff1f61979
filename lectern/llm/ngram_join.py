"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct sets of 5-word shingles (documents with equal sets are one row), columns are shingles.
Two rows link when 100 * |A and B| >= 80 * |A or B|.

The product is taken in blocks of columns, and overlap counts are carried from block to block. The columns of each row are
put in one global order, rare ones first (how often a column is met comes from counters of a fixed size, any order gives
right results). Size-derived bounds: a partner of a row of n shingles has at least ceil(0.8 n) of them in common, so that two
linked rows meet in the first n - ceil(0.8 n) + 1 columns of both. This leading block tells which pairs have a count at all;
from the place of a common column in both rows follows the most that they may still have in common, and pairs that can't
reach the bound are discarded. All columns are then multiplied in BLOCKS blocks, by the first bits of the shingle: a pair's
count grows by what its rows share in the block, and it is discarded as soon as its count and the columns left in the
smaller row can't reach the bound. What has the whole count at the end is exact.

Groups of near copies aren't expanded to all pairs. In each column, rows are first paired with one pivot (the row that
has the fewest rarer columns). Only pairs of a column whose rows aren't in one component by these links go on to a
second product. So no link between components is lost. A pivot that holds much of all pairs (at most HOT rows do) is salted:
its pairs are dealt to many tasks, its columns copied to each.
Components: alternating large-star and small-star steps on the links between rows, tables in the shared folder between the
steps; then the least doc_id of each component.

Defined cases: null or wordless text: empty set, n_shingles 0, component_id its own doc_id. Fewer than five words: the
whole sequence is one shingle. Repeated doc_ids: the rows' sets are linked apart and each row gets its set's component. A
document with null doc_id carries links like any other; null is a component_id only where no member has a doc_id. Texts of
any length are taken whole. Ties: none matters, any pivot and any order of columns gives the same components. No rows: no
rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import GOLD, U64, arrow_map, binary_values, discard, materialize, merged_counters, mix, pack_counters, sliced, table, trim, unpacked_counters, word_hashes

WIDTH, SHARE = 5, 80  # words of a shingle, hundredths of the union
COUNTER_BITS, FILTER_BITS = 20, 24
BLOCKS, HOT = 4, 4096  # blocks of columns; pivots with at least 1 / HOT of all pairs are salted


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    a, sizes = word_hashes(texts)
    n = len(a) - width + 1
    rolled = a[:0]
    if n > 0:
        rolled = a[:n].copy()
        for k in range(1, width):
            rolled *= GOLD
            rolled += a[k : k + n]
        rolled = mix(rolled)
    out, end = [], 0
    for size in sizes.tolist():
        start, end = end, end + size
        if size >= width:
            s = np.sort(rolled[start : end - width + 1])
            new = s[1:] != s[:-1]
            out.append(s if new.all() else s[np.concatenate([[True], new])])
        elif size:
            short = np.full(1, size, U64)
            for h in a[start:end]:
                short = mix(short * GOLD + h)
            out.append(short)
        else:
            out.append(a[:0])
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit key of the whole set, signed; 0 for the empty one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        key = mix(np.array([mix(s ^ GOLD).sum(dtype=U64) + U64(len(s))], U64))[0]
    return int(key.astype(np.int64))


def least_overlap(n: int, share: int = SHARE) -> int:
    return -(-share * n // 100)


def signed_keys(batch: pa.RecordBatch) -> np.ndarray:
    """Mixed keys of a batch whose first column is a long."""
    return mix(np.asarray(batch.column(0)).astype(np.int64).view(U64))


def _texts(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    trim()
    for whole in batches:
        at = whole.schema.get_field_index(name)
        for b in sliced(whole, at):
            yield b, binary_values(b.column(at))
    whole = b = None  # the worker may stand idle for long
    trim()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long links -> (node, root): the least node of each component, for all nodes in links."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, now = now, materialize(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(last)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """(id, text_key, set_key, n_shingles, component, component_id): component_id is the least id reachable by links, component
    a key of the component itself (null for an empty set), text_key a hash of the text."""
    if not 0 < share <= 100:
        raise ValueError("share is in hundredths, 1 to 100")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int32)
        for b, ts in _texts(batches):
            sets = shingle_sets(ts, width)
            for s in sets:
                np.add.at(total, (s >> U64(64 - COUNTER_BITS)).astype(np.int64), 1)
            cols = [b.column(0), b.column(1), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
        yield from pack_counters(total, names)

    names = ["id", "t", "k", "n", "segment", "data"]
    described = materialize(arrow_map(texts, describe, "id long, t long, k long, n long, segment int, data binary"))
    sizes = described.where("segment is null").select("id", "t", "k", "n")
    first = materialize(sizes.where("n > 0").groupBy("k", "n").agg(F.min("id").alias("rep")))
    met = texts.sparkSession.sparkContext.broadcast(unpacked_counters(described.where("segment is not null").select("segment", "data"), COUNTER_BITS))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = met.value, set()
        for _, ts in _texts(batches):
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for s in shingle_sets(ts, width):
                n = len(s)
                key = set_key(s)
                if not n or key in seen:
                    continue
                if len(seen) < 500_000:  # only spares sending the same rows again
                    seen.add(key)
                p = n - least_overlap(n, share) + 1
                c = counts[(s >> U64(64 - COUNTER_BITS)).astype(np.int64)]
                if p < n:  # the first p in (count, shingle) order
                    edge = np.partition(c, p - 1)[p - 1]
                    idx = np.nonzero(c <= edge)[0]
                    idx = idx[np.argsort(c[idx], kind="stable")][:p]  # s is sorted
                else:
                    idx = np.argsort(c, kind="stable")
                for out, v in zip(cols, (s[idx].astype(np.int64), np.full(len(idx), key, np.int64), np.full(len(idx), n, np.int32), np.arange(len(idx), dtype=np.int32))):
                    out.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["h", "k", "n", "pos"])

    head = arrow_map(texts.select("text"), heads, "h long, k long, n int, pos int")
    head = materialize(head)
    # a column with one row makes no pair; its count tells, without gathering the column. Of two linked rows the smaller one has
    # their first common column among its first n * (100 - share) / (100 + share), so that a column without such a row makes none either
    early = F.max((100 + share) * F.col("pos") <= (100 - share) * F.col("n"))
    shared = materialize(head.groupBy("h").agg(F.count(F.lit(1)).alias("c"), early.alias("early")).where("c > 1 and early").select("h"))
    flags = texts.sparkSession.sparkContext.broadcast(merged_counters(shared, signed_keys, FILTER_BITS, flags=True))

    def maybe_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(flags.value[(signed_keys(b) >> U64(64 - FILTER_BITS)).astype(np.int64)] > 0))

    met_twice = materialize(arrow_map(head, maybe_shared, head.schema).join(shared, "h").distinct())
    discard(head, shared)
    pivots = met_twice.groupBy("h").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("q"), "k", "n", "pos")).alias("pivot"))
    rows = met_twice.join(pivots, "h")

    def reach(n1, p1, n2, p2):
        """Whether two rows that first meet at these places may still have enough in common."""
        most = F.least(n1 - p1, n2 - p2)
        return 100 * most >= share * (n1 + n2 - most)

    pair = lambda a, b: [F.col(x + c).alias(n + y) for x, y in ((a, "a"), (b, "b")) for c, n in (("k", ""), ("n", "n"))]
    star = rows.where((F.col("k") != F.col("pivot.k")) & reach(F.col("n"), F.col("pos"), F.col("pivot.n"), F.col("pivot.pos"))).select(*pair("pivot.", "")).distinct()
    star = materialize(star)
    first_links = linked(texts, star, width, share)
    # rows that are in one component already need no second product
    mark = components(first_links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("k"), F.col("root").alias("m"))
    marked = met_twice.join(mark, "k", "left").select("h", "k", "n", "pos", F.coalesce("m", "k").alias("m"))
    mixed = marked.groupBy("h").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo <> hi").select("h")
    open_rows = materialize(marked.join(mixed, "h", "left_semi"))
    l, r = open_rows.alias("l"), open_rows.alias("r")
    second = l.join(r, F.col("l.h") == F.col("r.h")).where((F.col("l.k") < F.col("r.k")) & (F.col("l.m") != F.col("r.m")) & reach(F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos"))).select(*pair("l.", "r.")).distinct()
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = materialize(second.join(done, ["a", "b"], "left_anti"))
    discard(met_twice, star, open_rows, mark)
    more_links = linked(texts, second, width, share)
    links = first_links.unionByName(more_links)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    discard(second, first_links, more_links)
    classes = first.join(roots, F.col("k") == F.col("node"), "left").select("k", "n", "rep", F.coalesce("root", "k").alias("root"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    class_of = classes.join(least, "root").select("k", "n", "root", "component_id")
    found = sizes.join(class_of, ["k", "n"], "left")
    return found.select("id", F.col("t").alias("text_key"), F.col("k").alias("set_key"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("root")).alias("component"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def block_of(s: np.ndarray, blocks: int) -> np.ndarray:
    """Where each block of columns begins in a sorted set, and the end."""
    edges = (np.arange(1, blocks, dtype=np.float64) / blocks * 2.0**64).astype(U64)
    return np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])


def linked(texts: DataFrame, pairs: DataFrame, width: int, share: int, blocks: int = BLOCKS) -> DataFrame:
    """The pairs (a, na, b, nb) of rows that link, as a table (a, b, common): overlap counts accumulated over the blocks of columns."""
    spark = texts.sparkSession
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k"))
    flags = spark.sparkContext.broadcast(merged_counters(wanted, signed_keys, FILTER_BITS, flags=True))

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag, seen = flags.value, set()
        for _, ts in _texts(batches):
            keys, numbers, values = [], [], []
            for s in shingle_sets(ts, width):
                key = set_key(s)
                if len(s) and key not in seen and flag[int(mix(np.array([key], np.int64).view(U64))[0] >> U64(64 - FILTER_BITS))]:
                    if len(seen) < 500_000:  # only spares sending the same rows again
                        seen.add(key)
                    cuts = block_of(s, blocks)
                    for j in range(blocks):
                        keys.append(key)
                        numbers.append(j)
                        values.append(s[cuts[j] : cuts[j + 1]].view(np.int64))
            for at in range(0, len(keys), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 1000], pa.int64()), pa.array(numbers[at : at + 1000], pa.int32()), pa.array(values[at : at + 1000], pa.list_(pa.int64()))], names=["k", "block", "s"])

    sets = materialize(arrow_map(texts.select("text"), incidence, "k long, block int, s array<long>").dropDuplicates(["k", "block"]), "block")
    total = pairs.count()
    held = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") * HOT >= total)  # at most HOT rows
    salts = materialize(held.select("a", F.ceil(F.col("c") * 256 / F.lit(max(total, 1))).cast("int").alias("salts")).where("salts > 1"))
    n_salts = F.coalesce("salts", F.lit(1))
    dealt = pairs.join(F.broadcast(salts), "a", "left").select("a", "na", "b", "nb", F.pmod(F.xxhash64("b"), n_salts).cast("int").alias("salt"))
    counts = dealt.withColumns({"common": F.lit(0), "la": F.col("na"), "lb": F.col("nb")})
    for j in range(blocks):
        rows = sets.where(F.col("block") == j)
        ours = rows.join(F.broadcast(salts), F.col("k") == F.col("a"), "left").select("k", F.explode(F.sequence(F.lit(0), n_salts - 1)).alias("copy"), F.col("s").alias("x"))
        theirs = rows.select(F.col("k").alias("other"), F.col("s").alias("y"))
        both = counts.join(theirs, F.col("b") == F.col("other")).join(ours, (F.col("a") == F.col("k")) & (F.col("salt") == F.col("copy")))
        now = F.col("common") + F.size(F.array_intersect("x", "y"))
        after = both.select("a", "na", "b", "nb", "salt", now.alias("common"), (F.col("la") - F.size("x")).alias("la"), (F.col("lb") - F.size("y")).alias("lb"))
        most = F.col("common") + F.least("la", "lb")
        before, counts = counts, materialize(after.where(100 * most >= share * (F.col("na") + F.col("nb") - most)))  # one block's shuffle at a time is on the disk
        if j:
            discard(before)
    found = materialize(counts.select("a", "b", "common"))  # no columns are left: the bound is the condition itself
    discard(sets, salts, counts)
    return found


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
