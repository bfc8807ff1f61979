"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the average of the embeddings of its subwords: character 1- to 4-grams of its lower-cased letters, words
bounded by one blank, hashed into a table. A linear softmax over the average gives the language. Embeddings and
softmax are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows (at most
MAX_TRAIN_ROWS of the MAX_LANGS most frequent languages, dealt evenly to the languages by hash). What reaches the driver
are a text's hashed counts, at most 2**BITS numbers however long it is. Every tenth row of a language fits the temperature
of the softmax and the score below which a prediction is rejected, so that predictions that stay reach the wanted accuracy.

As the model is linear in the average, a prediction sums one row of (table x languages) per subword: whole texts of any
length are counted in slices that share no subword and add no bound.

Defined cases: null text, or one with no letter: `und`, score 0, rejected. No labelled rows, an empty table: every text is
`und`. Ties: of equal scores the language that sorts first; of rows with one id the text's hash gives the order of training.
Repeated rows count as often as they stand there. Languages with under ten rows have none in the calibration. Columns named
lang_pred, score or rejected give way; lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import GOLD, U64, crc_mod, map_texts, mix, table

BITS, DIM, ORDERS, SLICE = 16, 16, (1, 2, 3, 4), 1 << 20
MAX_TRAIN_ROWS, MAX_LANGS = 1600, 256
WANTED = 0.995

_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def letters(text: str) -> np.ndarray:
    """The lower-cased letters of a text, 0 for a blank: one between words and one at either end."""
    text, table_ = text.lower(), _letter_table()
    parts = []
    for at in range(0, len(text), SLICE):
        cp = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        parts.append(np.where(table_[cp], cp, 0).astype(np.uint32))
    cp = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 0) | (cp[:-1] != 0)
    return np.concatenate([[0], cp[keep], [0]]).astype(np.uint32)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Table slots of a text's subwords, in slices by the place where they begin."""
    cp = letters(text)
    for at in range(0, len(cp), SLICE):
        for order in ORDERS:
            part = cp[at : at + SLICE + order - 1].astype(U64)
            n = len(part) - order + 1
            if n <= 0:
                break
            h = np.full(n, order, U64)
            for k in range(order):
                h = h * GOLD + part[k : k + n] + U64(1)
            inner = np.ones(n, bool)
            for k in range(1, order - 1) if order > 1 else [0]:
                inner &= part[k : k + n] != 0
            if order == 2:
                inner &= (part[:n] != 0) | (part[1 : 1 + n] != 0)
            yield (mix(h[inner]) >> U64(64 - BITS)).astype(np.int64)


def slot_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The slots that a text's subwords meet, and how often."""
    if not text or not has_letter(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(1 << BITS, np.int64)
    for slots in subwords(text):
        total += np.bincount(slots, minlength=1 << BITS)
    met = np.nonzero(total)[0]
    return met, total[met]


def has_letter(text: str) -> bool:
    return any(_letter_table()[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)].any() for at in range(0, len(text), SLICE))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (2**BITS, languages): embedding table times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, text: str) -> np.ndarray | None:
        if not text or not has_letter(text):
            return None
        total, n = np.zeros(len(self.langs)), 0
        for slots in subwords(text):
            total += np.bincount(slots, minlength=1 << BITS) @ self.weights if len(slots) > 20_000 else self.weights[slots].sum(0)
            n += len(slots)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        logits = self.logits(text) if text and self.langs else None
        if logits is None:
            return "und", 0.0, True
        z = logits / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.reject_below)


def train(rows: Sequence[tuple[np.ndarray, np.ndarray, str]], epochs: int = 8, rate: float = 0.5, seed: int = 7, wanted: float = WANTED) -> Model:
    """Stochastic gradient descent over (slots, counts, language), one text a step, the rate falling to nought."""
    langs = sorted({row[2] for row in rows})
    rng = np.random.default_rng(seed)
    table_ = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    fit, held, met = [], [], dict.fromkeys(langs, 0)
    for slots, counts, lang in rows:
        if len(slots):
            met[lang] += 1
            (fit if met[lang] % 10 else held).append((slots, (counts / counts.sum()).astype(np.float32), langs.index(lang)))
    steps, step = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            slots, share, y = fit[k]
            now = rate * (1 - step / steps)
            e = share @ table_[slots]
            z = e @ soft + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            down = soft @ g
            soft -= now * 20 * np.outer(e, g)
            bias -= now * 0.1 * g
            table_[slots] -= now * 20 * share[:, None] * down[None, :]
            step += 1
    weights = (table_ @ soft).astype(np.float64)
    model = Model(langs, weights, bias.astype(np.float64), 1.0, 0.0)
    if held and len(langs) > 1:
        z = np.array([share @ weights[slots] + bias for slots, share, _ in held])
        y = np.array([d[2] for d in held])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

        model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        s = z / model.temperature
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p.max(1), kind="stable")
        right = (p.argmax(1) == y)[order]
        good = np.nonzero(np.cumsum(right) / np.arange(1, len(y) + 1) >= wanted)[0]
        model.reject_below = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return model


def training_sample(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, max_rows: int = MAX_TRAIN_ROWS, max_langs: int = MAX_LANGS) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Hashed counts and language of about max_rows labelled rows at most, as many of each of the max_langs most frequent
    languages, chosen by the hash of the id."""
    text, lang, id_ = (F.col(c).cast("string").alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (id_col, "id")))
    rows = labelled.select(id_, lang, text).where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not counts:
        return []
    each = max(1, max_rows // len(counts))
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) / 1e6
    limits = F.broadcast(rows.sparkSession.createDataFrame([(k, min(1.0, each / v)) for k, v in counts.items()], "lang string, share double"))  # max_langs rows
    chosen = rows.join(limits, "lang").where(share < F.col("share")).select("lang", F.xxhash64("id").alias("h"), F.xxhash64("text").alias("t"), "text")

    def fn(texts: list[bytes | None]):
        made = [slot_counts(t.decode("utf-8", "replace") if t is not None else None) for t in texts]
        return [m[0].tolist() for m in made], [m[1].tolist() for m in made]

    fields = T.StructType().add("slots", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.LongType()))
    counted = map_texts(chosen, "text", fn, fields, keep=["lang", "h", "t"])
    return [(np.array(r.slots, np.int64), np.array(r.counts, np.float64), r.lang) for r in counted.orderBy("h", "t").limit(2 * max_rows).collect()]


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred, score, rejected."""

    def fn(texts: list[bytes | None]):
        made = [model.predict(t.decode("utf-8", "replace") if t is not None else None) for t in texts]
        return [m[0] for m in made], [m[1] for m in made], [m[2] for m in made]

    return map_texts(docs, text_col, fn, T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean"), keep)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 4) == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(training_sample(docs.where(~held_out()), "text", "lang", "doc_id"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
