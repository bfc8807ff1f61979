"""Language-model scoring with a probabilistic suffix tree over tokens.

Symbols are the lower-cased words of a text, then one end; all words that training never met are one symbol, unknown.
States are contexts of up to three tokens of the text. A context's successors are kept if they follow it at least LEAST
times; a context is retained if its count times the Kullback-Leibler divergence of its next-symbol distribution (its
kept successors, and all others as one) from that of the context without its first token reaches MIN_GAIN nats. Both
bounds are absolute: the tree grows with the input, and a passage is treated alike in a small and in a large table.

Smoothing: a count loses DISCOUNT, what is freed goes to the shorter retained suffix, at the root to the unknown symbol.
Every token is predicted from the longest retained suffix of what stands before it, and every distribution adds up to 1.

The tree is dealt by the last token of a context: all contexts that end with one token, and so each with all its suffixes, are
in one shard. Each block of texts sends every different run of four tokens once to the shard of its third token, with
how often training met it and which texts of the block have it; the shard adds up the counts of all blocks, grows its part of the tree,
and scores the same runs with it. Texts, sequences and tree cross the network once, in this one shuffle of packed runs;
what comes back are sums for each text. A shard has about SHARD runs, and one with more holds them packed and grows and scores its part
in passes of about as many: contexts that end with a token are in one pass, or, of a token with too many, those that end with the same
two. A token with more than 2 * HELD occurrences is dealt to several shards in this way, HELD in each. Its own successors, which all of
them need, are counted beforehand, in a shard by a pass over its packed runs.
Counts of the HEADS most frequent words at most are broadcast, and give runs short codes; counts of rarer words are joined to the shards
that need them.

Defined cases: null text is empty: one token, the end. No training rows: N = V = 0 and every score is 0. Repeated
rows are rows of their own; a null doc_id counts as empty text in the split. Ties: none matters. Texts of any length are scored
whole: sums of a text are added up in double precision from single-precision sums of its runs by shard, so that they hold about
seven digits. An empty table gives an empty one. Columns that aren't asked for aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import GOLD, U64, arrow_map, binary_values, crc_mod, materialize, mix, sliced, table, trim, word_hashes

LEAST, MIN_GAIN, HEADS, SHARD, HELD, BLOCK_TOKENS = 2, 10.0, 1 << 19, 1 << 20, 1 << 23, 1 << 19
END = U64(0x0E0D)  # words are hashes; that one of them is this value is as unlikely as any collision
RUNS, COUNTS, PAIRS, IDS, SUMS = range(5)  # kinds of rows


def token_stream(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, ends included, and the number of tokens of each text."""
    words, sizes = word_hashes(texts)
    sizes = sizes + 1
    tokens = np.full(len(words) + len(texts), END, U64)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(sizes) - 1] = False
    tokens[inner] = words
    return tokens, sizes


def blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows of about BLOCK_TOKENS tokens, their tokens, and the number of tokens of each row; a longer text is a block."""
    rows, held, n = [], [], 0

    def made():
        return pa.Table.from_batches(rows), np.concatenate([t for t, _ in held]), np.concatenate([s for _, s in held])

    trim()
    for b in (part for whole in batches for part in sliced(whole, text)):
        tokens, sizes = token_stream(binary_values(b.column(text)))
        rows.append(b)
        held.append((tokens, sizes))
        n += len(tokens)
        if n >= BLOCK_TOKENS:
            yield made()
            rows, held, n = [], [], 0
    if held:
        yield made()
    rows, held, b = [], [], None
    trim()


def factor(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each token among the different ones, and these, in the order in which they come."""
    inverse, u = pd.factorize(tokens.view(np.int64))
    return inverse, u.view(U64)


def ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys replaced by small numbers of the same order, and how many there are."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.zeros(len(keys), np.int64)
    new[1:] = sorted_[1:] != sorted_[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum()) + 1


def ordered(*keys: np.ndarray) -> np.ndarray:
    """As np.lexsort, the first key sorting first: keys are put into one number, which sorts faster than each by itself."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    whole, held = keys[0], int(keys[0].max()).bit_length()
    for k in keys[1:]:
        width = int(k.max()).bit_length()
        if held + width > 62:
            whole, n = ranks(whole)
            held = n.bit_length()
            if held + width > 62:
                k, n = ranks(k)
                width = n.bit_length()
        whole, held = whole << width | k, held + width
    return np.argsort(whole)


def count_words(texts: DataFrame) -> DataFrame:
    """One text column -> (h, c): counts of tokens by hash, the end among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, _ in blocks(batches, 0):
            inverse, u = factor(tokens)
            c = np.bincount(inverse, minlength=len(u))
            for at in range(0, len(u), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 500_000].view(np.int64)), pa.array(c[at : at + 500_000])], names=["h", "c"])

    return arrow_map(texts, count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """What all shards share: totals, and the counts of the most frequent words, by code (frequent first) and by hash."""

    total: int
    different: int
    discount: float
    shards: int
    capacity: int  # runs of one pass
    held: int  # a word with more than twice as many occurrences is dealt to several shards
    hashes: np.ndarray  # sorted
    codes: np.ndarray  # of the sorted hashes
    counts: np.ndarray  # by code
    words: np.ndarray  # hashes by code

    @property
    def unknown(self) -> float:
        return self.discount * self.different / self.total if self.total else 1.0

    @property
    def floor(self) -> float:
        return float(np.log10(self.total + self.different + 1))

    def code(self, words: np.ndarray) -> np.ndarray:
        """Codes of word hashes, -1 for words that are none of the heads."""
        if not len(self.hashes):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.codes[at], -1)

    def parts(self, codes: np.ndarray) -> np.ndarray:
        """To how many shards the words of these codes are dealt."""
        c = np.where(codes >= 0, self.counts[np.maximum(codes, 0)], 0) if len(self.counts) else np.zeros(len(codes), np.int64)
        return np.where(c > 2 * self.held, -(-c // self.held), 1)

    def shard(self, word: np.ndarray, part: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(word + (part.astype(U64) + U64(1)) * GOLD) % U64(self.shards)).astype(np.int64)


def prepare(words: DataFrame, shard: int = SHARD, heads: int = HEADS, held: int = HELD) -> Model:
    """The totals and heads of a table of word counts; at most `heads` words reach the driver."""
    total, different, once, twice = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    met = {r[0]: r[1] for r in words.groupBy(F.least("c", F.lit(4096)).alias("c")).count().collect()}
    least, n = 4097, 0
    for c in range(4096, 0, -1):
        n += met.get(c, 0)
        if n > heads:
            break
        least = c
    if least > 4096 and met:  # more frequent words than fit: those of a share of all tokens that only so many can have
        least = max(4097, -(-total // max(heads, 1)))
    head = words.where(F.col("c") >= least).select("h", "c").toArrow()
    hashes, counts = head.column(0).to_numpy().astype(np.int64), head.column(1).to_numpy().astype(np.int64)
    order = np.lexsort((hashes, -counts))
    hashes, counts = hashes.view(U64)[order], counts[order]
    by_hash = np.argsort(hashes)
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Model(int(total), int(different), once / (once + 2 * twice) if once and twice else 0.5, max(partitions, -(-int(total) // shard)), shard, held, hashes[by_hash], by_hash, counts, hashes)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of nonnegative 32-bit integers, byte by byte of all, compressed."""
    import zstandard

    parts = [np.array([len(c) for c in columns], np.uint32).tobytes()]
    for c in columns:
        parts.append(np.ascontiguousarray(np.asarray(c).astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, np.uint32, n), 4 * n, []
    for size in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1))
        at += 4 * size
    return out


def _before(tokens: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
    """The token k places before each, 0 where the text begins later."""
    out = np.zeros(len(tokens), U64)
    out[k:] = tokens[: len(tokens) - k]
    out[reach < k] = 0
    return out


def _reach(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _dealt(model: Model, before: np.ndarray, word: np.ndarray, codes: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The shard of each run: that of its third token, or of the last one where the text begins with it."""
    part = (mix(before + U64(1)) % model.parts(codes).astype(U64)).astype(np.int64)
    return np.where(word == 0, model.shard(token, np.zeros(len(token), np.int64)), model.shard(word, part))


def deal(rows: DataFrame, model, id_fields: list[T.StructField]) -> DataFrame:
    """(text, train, ids..) -> rows of kind RUNS (shard, block, data) and IDS (block, idx, n_tokens, n_known, base, ids..)."""
    names = [f.name for f in id_fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        block = TaskContext.get().partitionId() << 32
        for held, tokens, sizes in blocks(batches, 0):
            train = np.nan_to_num(held.column(1).to_numpy(zero_copy_only=False).astype(np.float64)).astype(bool)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            inverse, u = factor(tokens)
            code = m.code(u)
            c = np.where(code >= 0, m.counts[np.maximum(code, 0)], 0) if len(m.counts) else np.zeros(len(u), np.int64)
            known, base = (np.bincount(doc, weights=x[inverse], minlength=len(sizes)) for x in ((c > 0).astype(np.float64), np.where(code >= 0, np.log10(c + 1.0), 0.0)))
            # ids of rows; their counts of rarer words come from the shards
            yield _batch(names, kind=np.full(len(sizes), IDS), shard=np.arange(len(sizes)) % m.shards, block=np.full(len(sizes), block), idx=np.arange(len(sizes)), n_tokens=sizes, n_known=known.astype(np.int64), base=base - sizes * m.floor, ids=[held.column(n + 2).combine_chunks() for n in range(len(names))])
            reach = _reach(sizes)
            # a block's own numbers of tokens: heads by code, then the others
            other = np.nonzero(code < 0)[0]
            own = code.copy()
            own[other] = len(m.hashes) + np.arange(len(other))
            dense = np.empty(len(own), np.int64)  # sorting takes them without gaps, in the same order
            dense[np.argsort(own)] = np.arange(1, len(own) + 1)
            numbers = np.concatenate([[0], own[np.argsort(own)] + 1])  # 0 is the start
            x = dense[inverse]
            w, b, a = (np.where(reach >= k, np.concatenate([np.zeros(min(k, len(x)), np.int64), x[:-k]]), 0) if len(x) > k else np.zeros(len(x), np.int64) for k in (1, 2, 3))
            order = ordered(w, b, a, x, doc)
            head, tail = numbers[w] << 32 | numbers[b], numbers[a] << 32 | numbers[x]
            head, tail, doc = head[order], tail[order], doc[order]
            new = np.ones(len(head), bool)
            new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
            first = np.flatnonzero(new)  # of each different run
            post = new.copy()
            post[1:] |= doc[1:] != doc[:-1]
            at = np.flatnonzero(post)  # of each text that has it
            times = np.diff(np.append(at, len(doc)))
            learnt = np.add.reduceat(train[doc].astype(np.int64), first) if len(first) else first
            texts = np.add.reduceat(post.astype(np.int64), first) if len(first) else first
            lookup = np.concatenate([np.zeros(1, U64), np.zeros(len(m.hashes), U64), u[other]])
            if len(m.hashes):
                lookup[1 + m.codes] = m.hashes
            word, before, token = lookup[head[first] >> 32], lookup[head[first] & 0xFFFFFFFF], lookup[tail[first] & 0xFFFFFFFF]
            codes = np.where((head[first] >> 32) <= len(m.hashes), (head[first] >> 32) - 1, -1)
            shard = _dealt(m, before, word, codes, token)
            by = np.argsort(shard, kind="stable")
            ends = np.cumsum(texts)
            cuts = np.searchsorted(shard[by], np.arange(m.shards + 1))
            out = []
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                g = by[cuts[s] : cuts[s + 1]]
                cols = [head[first[g]] >> 32, head[first[g]] & 0xFFFFFFFF, tail[first[g]] >> 32, tail[first[g]] & 0xFFFFFFFF]
                rare = np.unique(np.concatenate([v[v > len(m.hashes)] for v in cols]))
                cols = [np.where(v > len(m.hashes), len(m.hashes) + 1 + np.searchsorted(rare, v), v) for v in cols]
                which = np.repeat(ends[g] - texts[g], texts[g]) + np.arange(int(texts[g].sum())) - np.repeat(np.cumsum(texts[g]) - texts[g], texts[g])
                hashes = lookup[rare]
                out.append((s, pack([*cols, learnt[g], texts[g], doc[at[which]], times[which], hashes >> U64(32), hashes & U64(0xFFFFFFFF)])))
            for lo in range(0, len(out), 64):
                part = out[lo : lo + 64]
                yield _batch(names, kind=np.full(len(part), RUNS), shard=np.array([s for s, _ in part]), block=np.full(len(part), block), data=[d for _, d in part], c=np.diff(cuts)[[s for s, _ in part]])
            block += 1

    kinds = T.StructType([*_FIELDS.fields, *id_fields])
    arrow = _arrow(kinds)

    def _batch(names: list[str], ids=None, **given) -> pa.RecordBatch:
        n = len(given["kind"])
        cols = [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in list(arrow)[: len(_FIELDS)]]
        cols += [c.cast(f.type) for c, f in zip(ids, list(arrow)[len(_FIELDS) :])] if ids is not None else [pa.nulls(n, f.type) for f in list(arrow)[len(_FIELDS) :]]
        return pa.RecordBatch.from_arrays(cols, schema=pa.schema([pa.field(f.name, f.type) for f in arrow]))

    return arrow_map(rows, run, kinds)


_FIELDS = T.StructType().add("kind", "integer").add("shard", "long").add("block", "long").add("data", "binary").add("word", "long").add("next", "long").add("c", "long").add("idx", "long").add("n_tokens", "long").add("n_known", "long").add("base", "double")


def _arrow(fields: T.StructType) -> pa.Schema:
    from lectern.llm.common import to_arrow

    return to_arrow(fields)


def rare_counts(texts: DataFrame, words: DataFrame, model) -> DataFrame:
    """(shard, word, c): the counts of words that aren't heads, for the shards that predict them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for _, tokens, sizes in blocks(batches, 0):
            inverse, u = factor(tokens)
            code = m.code(u)
            at = np.flatnonzero(code[inverse] < 0)
            if not len(at):
                continue
            reach = _reach(sizes)
            w, b = _before(tokens, reach, 1)[at], _before(tokens, reach, 2)[at]
            shard = _dealt(m, b, w, np.where(reach[at] > 0, code[inverse[np.maximum(at - 1, 0)]], -1), tokens[at])
            order = ordered(inverse[at], shard)
            x, shard = inverse[at][order], shard[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (shard[1:] != shard[:-1])
            x, shard = u[x[new]].view(np.int64), shard[new]
            for lo in range(0, len(x), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(shard[lo : lo + 200_000]), pa.array(x[lo : lo + 200_000])], names=["shard", "word"])

    wanted = arrow_map(texts, run, "shard long, word long").distinct()
    return wanted.join(words.select(F.col("h").alias("word"), "c"), "word").select("shard", "word", "c")


def split_pairs(texts: DataFrame, model, least: int) -> DataFrame:
    """(shard, word, next, c): what follows the words that are dealt to several shards, for each of these."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for _, tokens, sizes in blocks(batches, 0):
            inverse, u = factor(tokens)
            hot = m.parts(m.code(u)) > 1
            at = np.flatnonzero((_reach(sizes)[1:] > 0) & hot[inverse[:-1]])  # the hot token stands at `at`, what follows at `at` + 1
            x, y = inverse[at], inverse[at + 1]
            order = ordered(x, y)
            x, y = x[order], y[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            first = np.flatnonzero(new)
            c = np.diff(np.append(first, len(x)))
            x, y = u[x], u[y]
            for lo in range(0, len(first), 200_000):
                f = first[lo : lo + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(x[f].view(np.int64)), pa.array(y[f].view(np.int64)), pa.array(c[lo : lo + 200_000])], names=["word", "next", "c"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in batches:
            word = np.asarray(b.column(0)).view(U64)
            parts = m.parts(m.code(word))
            row = np.repeat(np.arange(len(word)), parts)
            part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            taken = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(m.shard(word[row], part)), *taken.columns], names=["shard", "word", "next", "c"])

    counted = arrow_map(texts, count, "word long, next long, c long").groupBy("word", "next").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    return arrow_map(counted, copies, "shard long, word long, next long, c long").distinct()


class Level:
    """Contexts of one length in a shard: kept successors and, for retained contexts, what they leave to their suffix.

    ctx and keys are sorted; a successor's key is its context's place and the code of the token."""

    def __init__(self, ctx: np.ndarray, row_ctx: np.ndarray, x: np.ndarray, c: np.ndarray, size: np.ndarray, q: np.ndarray, least: int, min_gain: float):
        kept = c >= least
        place, x, c, q = row_ctx[kept], x[kept], c[kept].astype(np.float64), q[kept]
        n = len(ctx)
        of = size[place].astype(np.float64) if len(place) else np.zeros(0)
        add = lambda v: np.bincount(place, weights=v, minlength=n) if len(place) else np.zeros(n)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = add(c * np.log(c / of / q))
            left = size - add(c)
            gain += np.where(left > 0, left * np.log(left / size / np.maximum(1 - add(q), 1e-12)), 0.0)
        some = add(np.ones(len(place))) > 0
        self.ctx, self.size = ctx, size
        self.retained = some & (gain >= min_gain)
        self.rest = np.maximum(1 - add((c - 0.5) / of if len(of) else c), 1e-9)
        self.keys, self.c, self.weight = place << 32 | x, c, (c - 0.5) / of if len(of) else c

    def share(self, place: np.ndarray, x: np.ndarray) -> np.ndarray:
        """c / size of successors of contexts that have them."""
        at = np.searchsorted(self.keys, place << 32 | x)
        return self.c[at] / self.size[place]

    def predict(self, place: np.ndarray, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities by the contexts at these places (-1: none), given those by their suffixes."""
        there = place >= 0
        there[there] = self.retained[place[there]]
        at = np.flatnonzero(there)
        if not len(at):
            return p
        key = place[at] << 32 | x[at]
        k = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        own = np.where(self.keys[k] == key, self.weight[k], 0.0)
        out = p.copy()
        out[at] = own + self.rest[place[at]] * p[at]
        return out


def find(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted values, -1 for those that aren't there."""
    if not len(sorted_):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


def summed(keys: tuple[np.ndarray, ...], c: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Different rows of the key columns (the first sorts first), and the sums of c."""
    order = ordered(*keys)
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return tuple(k[first] for k in keys), np.add.reduceat(c[order], first) if len(first) else c[:0]


def grouped(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted array, and the place of each value among them."""
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return sorted_[new], np.cumsum(new) - 1


def rare_words(run: list[np.ndarray]) -> np.ndarray:
    return (run[8].astype(U64) << U64(32)) | run[9].astype(U64)


def word_hashes_of(m: Model, numbers: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Hashes of a block's numbers of tokens, 0 for the start."""
    out, n, heads = np.zeros(len(numbers), U64), numbers.astype(np.int64), len(m.words)
    known, other = (n > 0) & (n <= heads), n > heads
    out[known], out[other] = m.words[n[known] - 1], rare[n[other] - heads - 1]
    return out


def passes(m: Model, packed: list[bytes], n_runs: int) -> Iterator[tuple[list[int], list[list[np.ndarray]], tuple]]:
    """The runs of a shard in parts of about m.capacity: blocks, unpacked runs, and the successors (word, next, c) and occurrences
    (word, size) of tokens that are in several parts."""
    none = (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)), (np.zeros(0, U64), np.zeros(0, np.int64))
    parts = max(1, -(-n_runs // m.capacity))
    if parts == 1:
        runs = []
        while packed:  # packed ones go as they are unpacked
            runs.append(unpack(packed.pop(), 10))
        yield list(range(len(runs) - 1, -1, -1)), runs, none
        return
    heads = len(m.words)
    met = np.zeros(heads + 1, np.int64)
    for d in packed:
        w = unpack(d, 10)[0]
        met += np.bincount(w[w <= heads], minlength=heads + 1)
    busy = met > m.capacity // 4
    busy[0] = False
    hot = busy & np.concatenate([[False], m.parts(np.arange(heads)) == 1])  # of the others the successors are known already
    pairs, waiting, size = ((np.zeros(0, U64), np.zeros(0, U64)), np.zeros(0, np.int64)), [], np.zeros(heads + 1, np.int64)
    for k, d in enumerate(packed):
        run = unpack(d, 10)
        at = np.flatnonzero((run[0] <= heads) & (run[4] > 0))
        at = at[hot[run[0][at]]]
        if len(at):
            size += np.bincount(run[0][at], weights=run[4][at], minlength=heads + 1).astype(np.int64)
            waiting.append((m.words[run[0][at].astype(np.int64) - 1], word_hashes_of(m, run[3][at], rare_words(run)), run[4][at].astype(np.int64)))
        if waiting and (k % 32 == 31 or k == len(packed) - 1):
            keys, c = pairs
            pairs = summed_words(*(np.concatenate([x, *(v[i] for v in waiting)]) for i, x in enumerate((*keys, c))))
            waiting = []
    given = (*pairs[0], pairs[1]), (m.words[np.flatnonzero(hot) - 1], size[hot])
    for part in range(parts):
        blocks_, runs = [], []
        for k, d in enumerate(packed):
            run = unpack(d, 10)
            rare = rare_words(run)
            w = run[0].astype(np.int64)
            by = word_hashes_of(m, run[0], rare)
            split = (w <= heads) & busy[np.minimum(w, heads)]
            by[split] = mix(word_hashes_of(m, run[1][split], rare) + U64(1))
            first = w == 0  # no context: by what follows
            by[first] = word_hashes_of(m, run[3][first], rare)
            mine = mix(by + GOLD) % U64(parts) == U64(part)
            if mine.any():
                posts = np.repeat(mine, run[5].astype(np.int64))
                runs.append([*(v[mine] for v in run[:6]), *(v[posts] for v in run[6:8]), *run[8:]])
                blocks_.append(k)
        if runs:
            yield blocks_, runs, given


def summed_words(w: np.ndarray, x: np.ndarray, c: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """summed for columns of hashes."""
    (a, b), c = summed((ranks(w)[0], ranks(x)[0]), c)
    return (np.unique(w)[a], np.unique(x)[b]), c


class Shard:
    """One shard's part of the tree, or a part of that. pairs and sizes: successors and occurrences of tokens that are in other parts too."""

    def __init__(self, m: Model, runs: list[list[np.ndarray]], counts: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], least: int, min_gain: float):
        self.m, heads = m, len(m.hashes)
        self.runs = runs
        met = [rare_words(r) for r in self.runs]
        self.rare = np.unique(np.concatenate([*met, pairs[0], pairs[1], counts[0]]))
        self.rare = self.rare[m.code(self.rare) < 0]
        count = np.zeros(len(self.rare), np.int64)
        at = find(self.rare, counts[0])
        count[at[at >= 0]] = counts[1][at >= 0]
        self.known = np.concatenate([m.counts, count])
        table_: list[list[np.ndarray]] = []
        for r, words in zip(self.runs, met):
            if len(words):
                back = (heads + 1 + np.searchsorted(self.rare, words)).astype(np.uint32)
                r[:4] = [np.where(v > heads, back[np.maximum(v.astype(np.int64) - heads - 1, 0)], v) for v in r[:4]]
            del r[8:]
            t = r[4] > 0
            if t.any():
                w, b, a, x, learnt = (v[t].astype(np.int64) for v in r[:5])
                table_.append([w << 32 | b, a << 32 | x, learnt])
        head, tail, c = (np.concatenate([t[k] for t in table_]) if table_ else np.zeros(0, np.int64) for k in range(3))
        del table_, met
        (head, tail), c = summed((head, tail), c)
        keep = head >> 32 > 0  # runs at the start of a text have no context
        head, tail, c = head[keep], tail[keep], c[keep]
        del keep
        x = tail & 0xFFFFFFFF
        # one token
        (w1, x1), c1 = summed((head >> 32, x), c)
        elsewhere = np.sort(self.number(sizes[0]))
        own = find(elsewhere, w1) < 0
        (w1, x1), c1 = summed((np.concatenate([w1[own], self.number(pairs[0])]), np.concatenate([x1[own], self.number(pairs[1])])), np.concatenate([c1[own], pairs[2]]))
        ctx, place = grouped(w1)
        size = np.bincount(place, weights=c1, minlength=len(ctx)) if len(ctx) else np.zeros(0)
        at = find(ctx, self.number(sizes[0]))  # of these tokens all occurrences are known, not only the pairs that are given
        size[at[at >= 0]] = sizes[1][at >= 0]
        self.one = Level(ctx, place, x1, c1, size, self.unigram(x1) / max(m.total, 1), least, min_gain)
        # two tokens
        two = (head & 0xFFFFFFFF) > 0
        (k2, x2), c2 = summed((head[two], x[two]), c[two])
        ctx, place = grouped(k2)
        size = np.bincount(place, weights=c2, minlength=len(ctx)) if len(ctx) else np.zeros(0)
        ok = c2 >= least
        q = np.ones(len(c2))
        q[ok] = self.one.share(np.searchsorted(self.one.ctx, ctx[place[ok]] >> 32), x2[ok])
        self.two = Level(ctx, place, x2, c2, size, q, least, min_gain)
        # three tokens: a context is the place of its last two and the first
        three = (tail >> 32) > 0
        h3, t3, c3 = head[three], tail[three], c[three]
        key = np.searchsorted(self.two.ctx, h3) << 32 | t3 >> 32
        ctx, place = grouped(key)
        size = np.bincount(place, weights=c3, minlength=len(ctx)) if len(ctx) else np.zeros(0)
        ok, x3 = c3 >= least, t3 & 0xFFFFFFFF
        q = np.ones(len(c3))
        q[ok] = self.two.share(key[ok] >> 32, x3[ok])
        self.three = Level(ctx, place, x3, c3, size, q, least, min_gain)

    def number(self, words: np.ndarray) -> np.ndarray:
        """The shard's numbers of tokens: heads by code, then the others; 0 is the start."""
        code = self.m.code(words)
        return np.where(code >= 0, code, len(self.m.hashes) + np.searchsorted(self.rare, words)) + 1

    def unigram(self, numbers: np.ndarray) -> np.ndarray:
        return self.known[numbers - 1].astype(np.float64) if len(self.known) else np.zeros(len(numbers))

    def score(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts of a block that have runs in this shard; sums of log10 p; how many rarer words are known; and their part of the base."""
        w, b, a, x, _, texts, doc, times = (v.astype(np.int64) for v in self.runs[block])
        c = self.unigram(x)
        m = self.m
        p = np.where(c > 0, (c - m.discount) / max(m.total, 1), m.unknown)
        p = self.one.predict(find(self.one.ctx, w), x, p)
        at = find(self.two.ctx, w << 32 | b)
        at[b == 0] = -1
        p = self.two.predict(at, x, p)
        deep = find(self.three.ctx, np.maximum(at, 0) << 32 | a)
        deep[(at < 0) | (a == 0)] = -1
        p = self.three.predict(deep, x, p)
        run = np.repeat(np.arange(len(w)), texts)
        rarer = x[run] > len(m.hashes)
        met = np.flatnonzero(np.bincount(doc))
        add = lambda v: np.bincount(doc, weights=v * times)[met]
        return met, add(np.log10(p)[run]), add(rarer & (c[run] > 0)), add(np.where(rarer, np.log10(c + 1)[run], 0.0))


def score(docs: DataFrame, train: Column, id_cols: list[str], text_col: str = "text", least: int = LEAST, min_gain: float = MIN_GAIN, shard: int = SHARD, heads: int = HEADS, held: int = HELD) -> DataFrame:
    """id_cols and n_tokens, n_known, train_tokens, base_score, score of all texts of docs, by the tree of those where train is true."""
    context = docs.sparkSession.sparkContext
    text = F.col(text_col).cast("string").alias("text")
    learnt = docs.where(train).select(text)
    words = materialize(count_words(learnt))
    m = prepare(words, shard, heads, held)
    sent = context.broadcast(m)
    id_fields = [T.StructField(f"id{k}", docs.schema[c].dataType) for k, c in enumerate(id_cols)]
    rows = docs.select(text, F.coalesce(train, F.lit(False)).cast("int").alias("train"), *[F.col(c).alias(f.name) for c, f in zip(id_cols, id_fields)])
    dealt = deal(rows, sent, id_fields)
    columns = dealt.columns

    def as_rows(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*[F.lit(kind).alias("kind") if c == "kind" else F.col(c) if c in df.columns else F.lit(None).cast(dealt.schema[c].dataType).alias(c) for c in columns])

    if m.different > len(m.hashes):  # else every word is a head
        dealt = dealt.unionByName(as_rows(rare_counts(docs.select(text), words, sent), COUNTS))
    if len(m.counts) and m.counts[0] > 2 * m.held:
        dealt = dealt.unionByName(as_rows(split_pairs(learnt, sent, least), PAIRS))
    ids = [f.name for f in id_fields]
    out = T.StructType([f for f in dealt.schema.fields if f.name in ("block", "data", "idx", "n_tokens", "n_known", "base", *ids)])
    arrow = _arrow(out)

    def grow(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, blocks_, counts, pairs, n_runs = [], [], [], [], 0
        for b in batches:
            kind = np.asarray(b.column(b.schema.get_field_index("kind")))
            col = lambda name, at: b.column(b.schema.get_field_index(name)).take(pa.array(at))  # noqa: B023, E731
            if (kind == IDS).any():
                at = np.flatnonzero(kind == IDS)
                yield pa.RecordBatch.from_arrays([col(f.name, at).cast(f.type) for f in arrow], schema=arrow)
            at = np.flatnonzero(kind == RUNS)
            runs += col("data", at).to_pylist()
            blocks_ += col("block", at).to_pylist()
            n_runs += int(np.asarray(col("c", at)).sum()) if len(at) else 0
            for k, held, names in ((COUNTS, counts, ("word", "c")), (PAIRS, pairs, ("word", "next", "c"))):
                at = np.flatnonzero(kind == k)
                if len(at):
                    held.append([np.asarray(col(n, at)) for n in names])
        if not runs:
            return
        joined = lambda held, k, t: np.concatenate([h[k] for h in held]).view(t) if held else np.zeros(0, t)
        known = (joined(counts, 0, U64), joined(counts, 1, np.int64))
        m: Model = sent.value
        given = joined(pairs, 0, U64), joined(pairs, 1, U64), joined(pairs, 2, np.int64)
        split = np.unique(given[0])
        of = m.counts[m.code(split)] if len(split) else np.zeros(0, np.int64)
        made: list[tuple[int, bytes]] = []
        for at, part_runs, (near, sizes) in passes(m, runs, n_runs):
            part = Shard(m, part_runs, known, tuple(np.concatenate(v) for v in zip(given, near)), (np.concatenate([split, sizes[0]]), np.concatenate([of, sizes[1]])), least, min_gain)
            for k, block in enumerate(at):
                met, *sums = part.score(k)
                made.append((blocks_[block], pack([met, *[s.astype(np.float32).view(np.uint32) for s in sums]])))
                if len(made) == 256:
                    yield _sums(made)
                    made = []
            part = part_runs = None
        if made:
            yield _sums(made)
        runs = None
        trim()

    def _sums(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
        given = {"block": pa.array([b for b, _ in made], pa.int64()), "data": pa.array([d for _, d in made], pa.binary())}
        return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(len(made), f.type) for f in arrow], schema=arrow)

    final = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in id_cols]).add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    wanted = _arrow(final)

    def gather(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_, sums = [], None
        for b in batches:
            col = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            has = np.asarray(col("data").is_valid())
            if (~has).any():
                rows_.append(b.filter(pa.array(~has)))
            for data in col("data").filter(pa.array(has)).to_pylist():
                doc, *v = unpack(data, 4)
                doc, v = doc.astype(np.int64), [x.view(np.float32).astype(np.float64) for x in v]
                if sums is None or (len(doc) and doc[-1] >= sums.shape[1]):
                    grown = np.zeros((3, max(1024, 2 * int(doc[-1] if len(doc) else 0) + 1)))
                    if sums is not None:
                        grown[:, : sums.shape[1]] = sums
                    sums = grown
                for k in range(3):
                    sums[k, doc] += v[k]  # a text is in a shard's sums once
        t = pa.Table.from_batches(rows_).combine_chunks() if rows_ else None
        if t is None:
            return
        idx = t.column("idx").to_numpy()
        if sums is None or sums.shape[1] <= idx.max():
            grown = np.zeros((3, int(idx.max()) + 1))
            if sums is not None:
                grown[:, : sums.shape[1]] = sums
            sums = grown
        known = t.column("n_known").to_numpy() + np.rint(sums[1, idx]).astype(np.int64)
        total = sent.value.total
        scores = sums[0, idx] if total else np.zeros(len(idx))
        cols = [*(t.column(c) for c in ids), t.column("n_tokens"), pa.array(known), pa.array(np.full(len(idx), total, np.int64)), pa.array(t.column("base").to_numpy() + sums[2, idx]), pa.array(scores)]
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, wanted)], schema=wanted)

    return dealt.groupBy("shard").applyInArrow(grow, out).groupBy("block").applyInArrow(gather, final)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 7) == 2


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    return score(docs, ~F.col("held_out"), ["doc_id", "held_out"])
