"""Rectangles on pages: overlap joins, non-maximum suppression, and fragments of one table across pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}.r"), F.col(f"{b}.r")) - F.greatest(F.col(f"{a}.l"), F.col(f"{b}.l"))
    h = F.least(F.col(f"{a}.b"), F.col(f"{b}.b")) - F.greatest(F.col(f"{a}.t"), F.col(f"{b}.t"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def area(a: str) -> Column:
    return (F.col(f"{a}.r") - F.col(f"{a}.l")) * (F.col(f"{a}.b") - F.col(f"{a}.t"))


def _cells(rects: DataFrame, size: int) -> DataFrame:
    """A row for each cell of a grid that a rectangle touches."""
    at = lambda c: F.floor(F.col(c) / size)
    last = lambda low, high: F.greatest(F.ceil(F.col(high) / size) - 1, at(low))
    wide = rects.withColumn("x", F.explode(F.sequence(at("l"), last("l", "r"))))
    return wide.withColumn("y", F.explode(F.sequence(at("t"), last("t", "b"))))


def overlaps(rects: DataFrame, percent: int = 70, cell: int = 100) -> DataFrame:
    """Pairs (a < b) of rectangles (doc, page, id, t, l, b, r) of one page whose intersection is at least `percent` of the smaller one.

    Rectangles meet in the cells of a grid that both touch, so that a page with very many of them is many small joins; a pair is
    reported in the first cell of its intersection only."""
    grid = _cells(rects, cell)
    a, b = grid.alias("a"), grid.alias("b")
    inter = intersection("a", "b")
    touch = (F.col("a.l") < F.col("b.r")) & (F.col("b.l") < F.col("a.r")) & (F.col("a.t") < F.col("b.b")) & (F.col("b.t") < F.col("a.b"))
    here = (F.floor(F.greatest("a.l", "b.l") / cell) == F.col("a.x")) & (F.floor(F.greatest("a.t", "b.t") / cell) == F.col("a.y"))
    keys = F.lit(True)
    for k in ("doc", "page", "x", "y"):
        keys = keys & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    joined = a.join(b, keys & (F.col("a.id") < F.col("b.id")) & touch & here)
    return joined.where(100 * inter >= percent * F.least(area("a"), area("b"))).select(F.col("a.doc").alias("doc"), F.col("a.page").alias("page"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), inter.alias("shared"))


def spanning(rects: DataFrame, percent: int = 70) -> DataFrame:
    """Rectangles that overlap at least two others which don't overlap each other.

    Those a rectangle overlaps are all pairs among themselves if, and only if, as many of these overlap as there are pairs: the pairs that
    don't overlap are never listed."""
    o = overlaps(rects, percent).select("doc", "page", "a", "b")
    both = o.union(o.select("doc", "page", "b", "a").toDF("doc", "page", "a", "b"))
    degree = both.groupBy("doc", "page", "a").agg(F.count(F.lit(1)).alias("n"))
    x, y = both.alias("x"), both.alias("y")
    # a triangle a, b1 < b2: b1 and b2 overlap a and each other
    near = o.alias("o").join(x, (F.col("o.doc") == F.col("x.doc")) & (F.col("o.page") == F.col("x.page")) & (F.col("o.a") == F.col("x.b")))
    triangles = near.join(y, (F.col("o.doc") == F.col("y.doc")) & (F.col("o.page") == F.col("y.page")) & (F.col("o.b") == F.col("y.b")) & (F.col("x.a") == F.col("y.a")))
    closed = triangles.groupBy(F.col("x.doc").alias("doc"), F.col("x.page").alias("page"), F.col("x.a").alias("a")).agg(F.count(F.lit(1)).alias("pairs"))
    found = degree.join(closed, ["doc", "page", "a"], "left")
    return found.where(F.col("n") * (F.col("n") - 1) / 2 > F.coalesce("pairs", F.lit(0))).select("doc", "page", F.col("a").alias("id"))


def suppress(rects: DataFrame, percent: int = 70) -> DataFrame:
    """(doc, page, id): greedy selection in order of quality (q descending, then id): a rectangle goes if it overlaps a selected one.

    By page, as each choice depends on those before it; one rectangle is held against all selected ones at once."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["q", "id"], ascending=[False, True])
        t, l, b, r = (frame[c].to_numpy(np.float64) for c in ("t", "l", "b", "r"))
        size = (r - l) * (b - t)
        chosen = np.zeros(len(frame), np.int64)
        n = 0
        for k in range(len(frame)):
            c = chosen[:n]
            inter = np.clip(np.minimum(r[k], r[c]) - np.maximum(l[k], l[c]), 0, None) * np.clip(np.minimum(b[k], b[c]) - np.maximum(t[k], t[c]), 0, None)
            if not (100 * inter >= percent * np.minimum(size[k], size[c])).any():
                chosen[n] = k
                n += 1
        return frame.iloc[chosen[:n]][["doc", "page", "id"]]

    kinds = ", ".join(f"{c} {rects.schema[c].dataType.simpleString()}" for c in ("doc", "page", "id"))
    return rects.groupBy("doc", "page").applyInPandas(pick, kinds)


def continuation_islands(fragments: DataFrame, *keys: str, order: list[str], continues: Column) -> DataFrame:
    """Number the runs of fragments: a new one starts where `continues` (over `prev`, the row before) isn't true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = fragments.withColumn("prev", F.lag(F.struct(*fragments.columns)).over(w))
    starts = F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("island", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("prev")
