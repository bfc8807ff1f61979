"""Symbol n-grams through word bounds: counting from a table of texts, and scoring by tables of (weight, rest) pairs.

A text is its words, each with a bound after it that is predicted like a symbol, and one bound before the first that is
part of the first contexts only. N-grams reach over the bounds between words, not over the start of a text. A model gives
p = weight(context, symbol) + rest(context) * p(shorter context) for the contexts it has, from the shortest to the
longest; it depends on the last n symbols, and is found once for sequences of n symbols that occur again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import GOLD, U64, arrow_map, binary_values, mix, trim

BOUND = 0x110001
_ORDER = U64(0xD6E8FEB86659FD93)


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of `bound word bound word ... bound` of each text, and the positions of the first bound of each text (and the end)."""
    parts = [f"\n{b'\n'.join(words).decode('utf-8', 'replace')}\n" if (words := t.split()) else "\n" for t in texts]
    cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cp[cp == 10] = BOUND
    return cp, np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]).astype(np.int64)


def reaches(n_all: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Symbols between each symbol and the start of its text; 0 at the start."""
    at = np.arange(n_all)
    if starts is None:
        return at
    return at - np.repeat(starts[:-1], np.diff(starts))


def grams(cp: np.ndarray, orders: int, starts: np.ndarray | None = None, reach: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order n: positions, keys of the n-grams that end there, keys of their contexts, and of the n-grams without
    their first symbol. starts: as of stream; without it, all symbols are one text. reach: in place of starts, of a part of a text."""
    n_all = len(cp)
    reach = reaches(n_all, starts) if reach is None else reach
    sym = (cp + 1).astype(U64)
    whole = sym.copy()
    before = np.zeros(n_all, U64)  # of the n - 1 symbols that end one earlier
    power = U64(1)
    ok = reach > 0
    keys = np.zeros(n_all, U64)
    with np.errstate(over="ignore"):
        for n in range(1, orders + 1):
            if n > 1:
                power = power * GOLD
                step = np.zeros(n_all, U64)
                step[n - 1 :] = sym[: n_all - n + 1] * power
                shorter, whole = keys, whole + step
                ok = ok & (reach >= n - 1)
            else:
                shorter = np.full(n_all, mix(np.zeros(1, U64))[0])
            before = np.full(n_all, mix(np.zeros(1, U64))[0]) if n == 1 else np.concatenate([np.zeros(1, U64), keys[:-1]])
            keys = mix(whole + U64(n) * _ORDER)
            p = np.nonzero(ok)[0]
            if not len(p):
                return
            yield n, p, keys[p], before[p], shorter[p]


def last_symbols(cp: np.ndarray, reach: np.ndarray, lo: int, hi: int, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions from lo to hi that aren't the start of a text, and keys of the last symbols of the text there, `orders` of them
    or as many as there are."""
    first = max(lo - orders + 1, 0)
    sym = (cp[first:hi] + 1).astype(U64)
    reach = reach[first:hi]
    short = np.nonzero(reach < orders - 1)[0]
    with np.errstate(over="ignore"):
        key, power = np.full(len(sym), U64(orders - 1) * _ORDER), U64(1)
        for j in range(orders):
            key[j:] += sym[: len(sym) - j] * power
            power = power * GOLD
        few, power = reach[short].astype(U64) * _ORDER, U64(1)
        for j in range(orders - 1):
            far = reach[short] >= j
            few[far] += sym[short[far] - j] * power
            power = power * GOLD
    key[short] = few
    at = lo - first + np.nonzero(reach[lo - first :])[0]
    return first + at, mix(key[at])


class Windows:
    """Counts of the last symbols of a text, by fold. Those that meet a free slot of a table of a fixed size are added up there;
    what meets a slot that others have is given back at once."""

    names = ("a", "b", "c0", "c1")

    def __init__(self, orders: int, bits: int = 19):
        if orders > 6:
            raise ValueError("six symbols at most")
        self.orders, self.bits = orders, bits
        self.used, self.keys = np.zeros(1 << bits, bool), np.zeros(1 << bits, U64)
        self.packed, self.counts = np.zeros((2, 1 << bits), np.int64), np.zeros(2 << bits, np.int64)

    def pack(self, cp: np.ndarray, reach: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Symbols in two numbers, 21 bits for each, the last one in the first bits; 0 is none."""
        out = np.zeros((2, len(at)), np.int64)
        for j in range(self.orders):
            out[j // 3] |= np.where(reach[at] >= j, cp[at - j] + 1, 0) << (21 * (j % 3))
        return out

    def add(self, cp: np.ndarray, reach: np.ndarray, lo: int, hi: int, weight: np.ndarray, fold: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, key = last_symbols(cp, reach, lo, hi, self.orders)
        slot = (key >> U64(64 - self.bits)).astype(np.int64)
        free = np.nonzero(~self.used[slot])[0]
        if len(free):
            u, first = np.unique(slot[free], return_index=True)
            first = free[first]
            self.used[u], self.keys[u], self.packed[:, u] = True, key[first], self.pack(cp, reach, at[first])
        met = self.keys[slot] == key
        self.counts += np.bincount(2 * slot[met] + fold[at[met]], weights=weight[at[met]], minlength=len(self.counts)).astype(np.int64)
        if not met.all():
            at, key = at[~met], key[~met]
            u, first, back = np.unique(key, return_index=True, return_inverse=True)
            counts = np.bincount(2 * back + fold[at], weights=weight[at], minlength=2 * len(u)).astype(np.int64)
            yield from self._rows(self.pack(cp, reach, at[first]), counts)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._rows(self.packed[:, self.used], self.counts.reshape(-1, 2)[self.used].ravel())

    def _rows(self, packed: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        cols = (*packed, counts[::2], counts[1::2])
        for at in range(0, packed.shape[1], 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in cols], names=list(self.names))


def fold_counts(texts: DataFrame, orders: int, block: int = 1 << 20, bits: int = 19) -> DataFrame:
    """(text binary, c long, fold int, 0 or 1) -> (n, key, ctx, suf, c0, c1): counts of n-grams in each fold. What is sent are the
    different sequences of the last `orders` symbols, added up over a task; n-grams of all orders are found from them."""
    held_orders = max(orders, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pending, held = Windows(held_orders, bits), [], 0
        for b in batches:
            counts, folds = np.asarray(b.column(1)).astype(np.int64), np.asarray(b.column(2)).astype(np.int64)
            for i, t in enumerate(binary_values(b.column(0))):
                pending.append((t or b"", counts[i], folds[i]))
                held += len(t or b"")
                if held >= block:
                    yield from counted(table, pending)
                    pending, held = [], 0
        if pending:
            yield from counted(table, pending)
        yield from table.rest()
        table = b = pending = None
        trim()

    def counted(table: Windows, pending: list) -> Iterator[pa.RecordBatch]:
        cp, starts = stream([t for t, _, _ in pending])
        reach, sizes = reaches(len(cp), starts), np.diff(starts)
        weight, fold = (np.repeat(np.array([x[i] for x in pending], np.int64), sizes) for i in (1, 2))
        for lo in range(0, len(cp), block):  # long texts in parts
            yield from table.add(cp, reach, lo, min(lo + block, len(cp)), weight, fold)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each sequence as a small text of its own, whose last symbol counts."""
        for b in batches:
            packed = [np.asarray(b.column(i)) for i in (0, 1)]
            symbols = np.stack([packed[j // 3] >> (21 * (j % 3)) & 0x1FFFFF for j in reversed(range(held_orders))], axis=1)
            is_one = symbols > 0
            sizes = is_one.sum(axis=1)
            ends = np.cumsum(sizes)
            starts = np.concatenate([[0], ends])
            which = np.full(int(ends[-1]) if len(ends) else 0, -1)
            which[ends - 1] = np.arange(len(ends))
            for n, p, key, ctx, suf in grams(symbols[is_one] - 1, orders, starts):
                last = which[p] >= 0
                row = which[p[last]]
                cols = [np.full(len(row), n, np.int32), *(x[last].view(np.int64) for x in (key, ctx, suf)), *(np.asarray(b.column(i))[row] for i in (2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["n", "key", "ctx", "suf", "c0", "c1"])

    sums = F.sum("c0").alias("c0"), F.sum("c1").alias("c1")
    made = arrow_map(texts, count, "a long, b long, c0 long, c1 long").groupBy("a", "b").agg(*sums)
    return arrow_map(made, spread, "n int, key long, ctx long, suf long, c0 long, c1 long").groupBy("n", "key", "ctx", "suf").agg(*sums)


def gram_counts(texts: DataFrame, orders: int, block: int = 1 << 20) -> DataFrame:
    """(text binary, c long) -> (n, key, ctx, suf, c): counts of n-grams."""
    return fold_counts(texts.withColumn("fold", F.lit(0)), orders, block).select("n", "key", "ctx", "suf", F.col("c0").alias("c"))


class Tables:
    """Sorted keys with values, dealt into shards by the keys' first bits; a batch's keys are joined shard by shard."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, shard_bits: int = 4):
        order = np.argsort(keys)
        self.keys, self.values, self.bits = keys[order], values[order].astype(np.float64), shard_bits
        self.cuts = np.searchsorted(self.keys, (np.arange(1, 1 << shard_bits, dtype=U64)) << U64(64 - shard_bits)) if len(keys) else np.zeros((1 << shard_bits) - 1, np.int64)

    def get(self, wanted: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(wanted), default)
        if not len(self.keys):
            return out
        order = np.argsort(wanted)
        sorted_ = wanted[order]
        ends = np.concatenate([[0], np.searchsorted(sorted_, (np.arange(1, 1 << self.bits, dtype=U64)) << U64(64 - self.bits)), [len(wanted)]])
        cuts = np.concatenate([[0], self.cuts, [len(self.keys)]])
        for s in range(1 << self.bits):
            a, b, lo, hi = ends[s], ends[s + 1], cuts[s], cuts[s + 1]
            if a == b or lo == hi:
                continue
            keys = self.keys[lo:hi]
            i = np.minimum(np.searchsorted(keys, sorted_[a:b]), hi - lo - 1)
            hit = keys[i] == sorted_[a:b]
            out[order[a:b][hit]] = self.values[lo:hi][i[hit]]
        return out


class GramModel:
    def __init__(self, orders: int, keys: np.ndarray, weights: np.ndarray, contexts: np.ndarray, rests: np.ndarray, floor: float):
        self.orders, self.floor = orders, floor
        self.weight, self.rest = Tables(keys.view(U64), weights), Tables(contexts.view(U64), rests)
        self._scores: TextScores | None = None

    def scores(self) -> TextScores:
        """One for this model, whose values the tasks of a worker share."""
        if self._scores is None:
            self._scores = TextScores(self)
        return self._scores

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_scores": None}

    def symbol_probabilities(self, cp: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        reach = reaches(len(cp), starts)
        p = np.full(len(cp), self.floor)
        at = np.nonzero(reach)[0]
        p[at] = self.probabilities_at(cp, reach, at)
        return p

    def probabilities_at(self, cp: np.ndarray, reach: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the symbols at these positions; none is the start of a text."""
        p = np.full(len(at), self.floor)
        whole, before, i = np.zeros(len(at), U64), np.zeros(len(at), U64), np.arange(len(at))
        power = U64(1)
        with np.errstate(over="ignore"):
            for n in range(1, self.orders + 1):
                i = i[reach[at[i]] >= n - 1]
                if not len(i):
                    break
                context = before[i] + U64(n - 1) * _ORDER if n > 1 else before[i]
                whole[i] += (cp[at[i] - n + 1] + 1).astype(U64) * power
                key, ctx = mix(whole[i] + U64(n) * _ORDER), mix(context)
                p[i] = self.weight.get(key, 0.0) + self.rest.get(ctx, 1.0) * p[i]
                longer = i[reach[at[i]] >= n]
                before[longer] += (cp[at[longer] - n] + 1).astype(U64) * power
                power = power * GOLD
        return p

    def log10_words(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word and its bound, as the first word of a text."""
        if not words:
            return np.zeros(0)
        cp, starts = stream(words)
        logs = np.log10(self.symbol_probabilities(cp, starts))
        logs[starts[:-1]] = 0
        return np.add.reduceat(logs, starts[:-1])


class TextScores:
    """log10 of the probability of texts. Values of sequences of symbols are remembered by their hash, in a table of a fixed
    size in which a later one takes the place of another."""

    def __init__(self, model: GramModel, bits: int = 21, part: int = 1 << 19):
        self.model, self.bits, self.part = model, bits, part
        self.keys, self.values = np.zeros(1 << bits, U64), np.zeros(1 << bits)

    def logs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text: log10 of its probability, and the number of symbols that were predicted."""
        return self.measured(texts)[:2]

    def measured(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As logs, and the number of words."""
        cp, starts = stream(texts)
        reach = reaches(len(cp), starts)
        sums = np.zeros(len(texts))
        text = np.repeat(np.arange(len(texts)), np.diff(starts))
        for lo in range(0, len(cp), self.part):
            at, logs = self._found(cp, reach, lo, min(lo + self.part, len(cp)))
            sums += np.bincount(text[at], weights=logs, minlength=len(texts))
        words = np.bincount(text[cp == BOUND], minlength=len(texts)) - 1
        return sums, np.diff(starts) - 1, words

    def _found(self, cp: np.ndarray, reach: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        at, key = last_symbols(cp, reach, lo, hi, self.model.orders)
        slot = (key >> U64(64 - self.bits)).astype(np.int64)
        out = self.values[slot]
        new = np.nonzero(self.keys[slot] != key)[0]
        if len(new):
            u, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            values = np.log10(self.model.probabilities_at(cp, reach, at[new[first]]))
            out[new] = values[back]
            slot = slot[new[first]]
            _, last = np.unique(slot[::-1], return_index=True)
            last = len(slot) - 1 - last
            self.keys[slot[last]], self.values[slot[last]] = u[last], values[last]
        return at, out
