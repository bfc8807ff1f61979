"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

The lattice of a text has an edge for each piece of the vocabulary that fits; characters without a piece take their
byte pieces. No piece holds a blank after another character or a line feed, so that the lattice of a text falls into units (a word with the blanks
before it, a line feed), found once for each different unit. Scores of the vocabulary are merge ranks, not
probabilities; a piece of rank r has the log weight -(ln(r + 10) + a constant), the constant making all weights add up to 1.

Search: a segmentation's log probability plus Gumbel noise is its key; the k greatest keys are a sample of k without
replacement. A-star search over lattice states (prefixes of segmentations) finds them without listing segmentations: the bound
of a state is the greatest key below it, drawn exactly as a Gumbel at the state's log mass cut off by its parent's key. The state with
the greatest bound is completed to a segmentation by sampling its edges; the states that leave that path, one for
each of its edges, take its place. The key that comes next after the k-th gives each sample's inclusion
score, the log of 1 - exp(-exp(log probability - next key)). All noise comes from a hash of seed, row key and position, so
that a row's samples don't depend on partitions, batches or other rows (rows with one key and text get equal samples).

Decoding joins the pieces' bytes and takes off the blank that encoding puts in front; it gives back any text unchanged.

Defined cases: null text: no samples, no rows. Empty text: one sample without pieces, log probability 0. Texts with fewer than k
segmentations: all of them, inclusion score 0 (certain). A null key counts as empty text. Whole texts are encoded. Ties of
keys (of 53-bit noise) go to the earlier state. An empty table gives an empty one. Columns named like the added ones give way;
any other name is handed through. The model file is the driver's; its bytes are broadcast.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import GOLD, U64, arrow_map, binary_values, mix, spare, table, trim

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_UNITS = re.compile(r" *[^ \n]+|\n| +")
#: Gumbel noise of a 53-bit number is less than MOST_NOISE, that of numbers under _LOUD less than LOUD_NOISE.
MOST_NOISE, LOUD_NOISE, FIRST_EDGES = 37.5, 5.0, 48
_LOUD = np.uint64(int(0.993 * 2**53))
BLOCK_CHARS, MOST_EDGES = 200_000, 2_000_000


class Vocabulary:
    """Pieces and weights of a SentencePiece model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        ranks = [0.0] * n
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = [-1] * 256
        normal: dict[str, int] = {}
        worst = max([-sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))], default=0.0)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[i], ranks[i] = i, bytes([value]), worst + 1
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                if " " in text.lstrip(" ") or "\n" in text:
                    continue  # would cross units
                normal[text], self.bytes[i], ranks[i] = i, text.encode(), -sp.get_score(i)
        used = list(normal.values()) + [i for i in self.byte_ids if i >= 0]
        shift = math.log(sum(1 / (ranks[i] + 10) for i in used))
        self.log_weight = np.full(n, -np.inf)
        for i in used:
            self.log_weight[i] = -math.log(ranks[i] + 10) - shift
        # transitions of the trie of pieces: (state, character) -> state
        states, moves, self.longest = {"": 0}, {}, max(map(len, normal), default=1)
        for text in normal:
            for end in range(1, len(text) + 1):
                if text[:end] not in states:
                    states[text[:end]] = len(states)
                    moves[states[text[: end - 1]] << 21 | ord(text[end - 1])] = states[text[:end]]
        # open addressing, few probes: the table is much larger than the number of moves
        self.slot_bits, self.probes = max(16, (8 * len(moves)).bit_length()), 0
        size = 1 << self.slot_bits
        self.move_keys, self.move_to = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int32)
        keys = np.array(list(moves), np.int64)
        for key, at in zip(keys.tolist(), self.slots(keys).tolist()):
            probe = 1
            while self.move_keys[at] >= 0:
                at, probe = at + 1, probe + 1
            self.move_keys[at], self.move_to[at] = key, moves[key]
            self.probes = max(self.probes, probe)
        self.state_piece = np.full(len(states), -1, np.int32)
        for text, i in normal.items():
            self.state_piece[states[text]] = i
        self.byte_weight = float(self.log_weight[self.byte_ids[0]]) if self.byte_ids[0] >= 0 else -50.0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(U64) * GOLD) >> U64(64 - self.slot_bits)).astype(np.int64)

    def move(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next state for each state and character; -1 if there is none."""
        keys = states << 21 | chars
        at = self.slots(keys)
        found = self.move_keys[at]
        out = np.where(found == keys, self.move_to[at], -1)
        open_ = np.nonzero((found != keys) & (found >= 0))[0]
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] += 1
            found = self.move_keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.move_to[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def expanded(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Piece ids of lists of edge codes; negative codes are characters in bytes."""
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        ends = np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)))
        at = np.nonzero(flat < 0)[0]
        if len(at):
            u, back = np.unique(flat[at], return_inverse=True)
            ids = [[self.byte_ids[b] for b in chr(-c - 1).encode()] for c in u.tolist()]
            width = np.ones(len(flat), np.int64)
            width[at] = np.array(list(map(len, ids)))[back]
            stops = np.cumsum(width)
            flat = np.repeat(flat, width)
            table = np.zeros((len(u), 4), np.int32)
            for i, x in enumerate(ids):
                table[i, : len(x)] = x
            for j in range(4):
                has = width[at] > j
                flat[(stops - width)[at[has]] + j] = table[back[has], j]
            ends = np.concatenate([[0], stops])[ends]
        return np.split(flat, ends[:-1]) if codes else []

    def decode(self, ids: Sequence[int]) -> bytes:
        data = b"".join(map(self.bytes.__getitem__, ids))
        return data[1:] if data[:1] == b" " else data


def split_units(text: str) -> list[str]:
    """The units of a text that isn't empty, with a blank put in front."""
    if "  " in text or text[0] == " " or "\0" in text:
        return _UNITS.findall(" " + text)
    if "\n" in text:
        return list(filter(None, (" " + text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))
    return (" " + text).replace(" ", "\0 ").split("\0")[1:]


class Lattices:
    """Nodes and edges of all units met so far; an edge has its probability, given its node.

    Nodes are numbered along the units; edge 0.. of node i are start[i] to start[i + 1], longest pieces first.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = defaultdict(count().__next__)  # in the order of first sight
        self.nodes = self.edges = self.built = 0
        self.root = np.zeros(0, np.int64)
        self.start, self.p, self.to, self.code = np.zeros(1, np.int64), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            grown = np.zeros(max(len(held) + len(held) // 4, at + len(values)), held.dtype)
            grown[:at] = held[:at]
            setattr(self, name, grown)
            held = grown
        held[at : at + len(values)] = values

    def add(self, units: list[str]) -> None:
        v = self.v
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        cp = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(cp)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(n)  # characters up to the unit's end
        order = np.argsort(left.astype(np.int16), kind="stable") if n and left.max() < 32_000 else np.argsort(left, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)  # nodes are numbered by their distance from the end
        counts = np.zeros(n, np.int64)
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        on, state, pos = np.arange(n), np.zeros(n, np.int64), order
        for k in range(v.longest):
            inside = left[pos] > k
            on, state, pos = on[inside], state[inside], pos[inside]
            if not len(on):
                break
            moved = v.move(state, cp[pos + k]).astype(np.int64)
            good = moved >= 0
            on, state, pos = on[good], moved[good], pos[good]
            piece = v.state_piece[state]
            whole = piece >= 0
            levels.append((on[whole], piece[whole], v.log_weight[piece[whole]]))
            counts[on[whole]] += 1
            if k == 0:
                lone = np.ones(n, bool)
                lone[on[whole]] = False
                lone = np.nonzero(lone)[0]
                c = cp[order[lone]]
                levels.append((lone, (-c - 1).astype(np.int32), v.byte_weight * (1.0 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))
                counts[lone] += 1
        starts = np.cumsum(counts) - counts
        total = int(counts.sum())
        code, weight, target = np.empty(total, np.int32), np.empty(total), np.empty(total, np.int64)
        cursor = starts.copy()
        for place, (at, piece, w) in reversed(list(enumerate(levels))):  # longest pieces first
            k = 0 if place < 2 else place - 1
            e = cursor[at]
            code[e], weight[e] = piece, w
            there = order[at] + k + 1
            last = left[order[at]] == k + 1
            target[e] = np.where(last, -1, rank[np.minimum(there, n - 1)])
            cursor[at] += 1
        mass = np.zeros(n + 1)  # log mass from each node to the end; the last one is the end itself (node -1)
        p = np.empty(total)
        bounds = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2)).tolist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            lo, hi = int(starts[a]), int(starts[b]) if b < n else total
            first, times = starts[a:b] - lo, counts[a:b]
            terms = weight[lo:hi] + mass[target[lo:hi]]
            top = np.maximum.reduceat(terms, first)
            x = np.exp(terms - np.repeat(top, times))
            s = np.add.reduceat(x, first)
            mass[a:b] = top + np.log(s)
            p[lo:hi] = x / np.repeat(s, times)
        self._put("p", self.edges, p)
        self._put("to", self.edges, np.where(target < 0, -1, self.nodes + target))
        self._put("code", self.edges, code)
        self._put("start", self.nodes + 1, self.edges + starts + counts)
        self._put("root", self.built, self.nodes + rank[ends - sizes])
        self.nodes, self.edges, self.built = self.nodes + n, self.edges + total, self.built + len(units)

    def of(self, units: list[str]) -> np.ndarray:
        """Root nodes of units."""
        numbers = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))
        new = list(islice(reversed(self.numbers), len(self.numbers) - self.built))[::-1]
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        at = 0
        while at < len(new):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 150_000)) + 1
            self.add(new[at:to])
            at = to
        return self.root[numbers]


def uniform(keys: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64-bit keys and counters."""
    with np.errstate(over="ignore"):
        bits = mix(mix(counters.astype(U64) + GOLD) ^ keys)
    return ((bits >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(start, p, to, nodes: np.ndarray, keys: np.ndarray, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample a path to the end of its unit from each node: edges of all paths one after the other, and their numbers."""
    n = len(nodes)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    at, node, step = np.arange(n), nodes, 0
    while len(at):
        u = uniform(keys[at], counters[at] + step)
        edge = start[node]
        u -= p[edge]
        over = np.nonzero((u > 0) & (edge + 1 < start[node + 1]))[0]
        while len(over):
            edge[over] += 1
            u[over] -= p[edge[over]]
            over = over[(u[over] > 0) & (edge[over] + 1 < start[node[over] + 1])]
        steps.append((at, edge))
        node = to[edge]
        on = node >= 0
        at, node, step = at[on], node[on], step + 1
    sizes = np.zeros(n, np.int64)
    for i, _ in steps:
        sizes[i] += 1
    first = np.cumsum(sizes) - sizes
    edges = np.empty(int(sizes.sum()), np.int64)
    for k, (i, e) in enumerate(steps):
        edges[first[i] + k] = e
    return edges, sizes


@dataclass
class Path:
    """One sample of one text: edges, the unit of each edge, and where it left the path it came from."""

    edges: np.ndarray
    unit: np.ndarray
    total: float
    split: int
    excluded: tuple[int, ...]
    key: float
    bounds: np.ndarray  # of the states that leave this path at each edge, the k greatest at least


def _bounds(logs: np.ndarray, p: np.ndarray, starts: np.ndarray, split: np.ndarray, spare: np.ndarray, key: np.ndarray, noise_keys: np.ndarray, k: int) -> np.ndarray:
    """Bounds of the states that leave paths at each edge, from `split` on; `spare` is the probability left at the split.
    Paths stand one after the other; starts: with the end.

    A state's log mass is at most that of the path before it, and noise is bounded: what can't be among a path's k greatest by
    the noise of the edge, or by any, isn't worked out and stays without a bound. No search asks for more than k of a path."""
    sizes = np.diff(starts)
    pos = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
    with np.errstate(over="ignore"):
        bits = mix(_mixed(int(sizes.max(initial=0)))[pos] ^ np.repeat(noise_keys, sizes)) >> U64(11)
    before = np.empty(len(logs))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        np.cumsum(logs[a:b], out=before[a:b])
    before -= logs
    out = np.full(len(logs), -np.inf)
    at_split = (starts[:-1] + split)[split < sizes]

    def work_out(at: np.ndarray) -> np.ndarray:
        left = 1.0 - p[at]
        here = np.searchsorted(at, at_split)
        met = here < len(at)
        met[met] = at[here[met]] == at_split[met]
        left[here[met]] = spare[split < sizes][met]
        with np.errstate(divide="ignore"):
            g = before[at] + np.log(np.maximum(left, 0.0)) - np.log(-np.log((bits[at].astype(np.float64) + 0.5) * 2.0**-53))
        g[left < 1e-14] = -np.inf
        path = np.searchsorted(starts, at, side="right") - 1
        out[at] = -np.logaddexp(-key[path], -g)
        return g

    first = np.minimum(starts[:-1] + split + FIRST_EDGES, starts[1:])
    counts = np.maximum(first - starts[:-1] - split, 0)
    ends = np.cumsum(counts)
    at = np.arange(int(counts.sum())) + np.repeat(starts[:-1] + split - (ends - counts), counts)
    g = work_out(at)
    worst = np.full(len(sizes), -np.inf)  # a path's k-th greatest so far
    for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
        if b - a >= k:
            worst[i] = np.partition(g[a:b], b - a - k)[b - a - k]
    need = np.repeat(worst, sizes) - before
    rest = (need <= MOST_NOISE) & ((need <= LOUD_NOISE) | (bits >= _LOUD)) & (pos >= np.repeat(split + FIRST_EDGES, sizes))
    work_out(np.nonzero(rest)[0])
    return out


_MIXED: list[np.ndarray] = [np.zeros(0, U64)]


def _mixed(n: int) -> np.ndarray:
    """The counters' part of uniform, of 0 to n at least; kept for counters up to 2**16."""
    if len(_MIXED[0]) >= n:
        return _MIXED[0]
    with np.errstate(over="ignore"):
        made = mix(np.arange(max(n, 1 << 12), dtype=U64) + GOLD)
    if n <= 1 << 16:
        _MIXED[0] = made
    return made


def sample_texts(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k samples (piece ids, log probability, log inclusion score), greatest key first."""
    if lattices.edges > MOST_EDGES:
        lattices.clear()
    units = [split_units(t) if t else [] for t in texts]
    sizes = np.array([len(u) for u in units], np.int64)
    roots = lattices.of([u for us in units for u in us])
    start, p, to, code = lattices.start, lattices.p, lattices.to, lattices.code
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    ordinal = np.arange(len(roots)) - np.repeat(ends - sizes, sizes)
    paths: list[list[Path]] = [[] for _ in texts]
    with np.errstate(over="ignore"):
        noise_keys = [mix(keys + U64(1000 + r)) for r in range(k)]
    root_key = -np.log(-np.log(uniform(keys, np.full(len(keys), 1))))

    def fresh(nodes: np.ndarray, d: np.ndarray, o: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        return walk(start, p, to, nodes, mix(keys + U64(2 + 2 * r))[d], o << 24)

    edges, per_unit = fresh(roots, doc, ordinal, 0)
    stop = np.cumsum(per_unit)
    found = []
    for i in range(len(texts)):
        a, b = ends[i] - sizes[i], ends[i]
        lo, hi = (stop[a - 1] if a else 0), (stop[b - 1] if b else 0)
        e = edges[lo:hi]
        found.append((i, paths[i], e, np.repeat(np.arange(b - a), per_unit[a:b]), 0, (), float(root_key[i])))
    _finish(found, p, noise_keys[0], k)
    for r in range(1, k):
        todo, nodes, d, o = [], [], [], []
        for i, have in enumerate(paths):
            best = max(range(len(have)), key=lambda x: have[x].bounds.max(initial=-np.inf), default=None)
            if best is None:
                continue
            q = have[best]
            t = int(q.bounds.argmax()) if len(q.bounds) else -1
            if t < 0 or q.bounds[t] == -np.inf:
                continue
            key = float(q.bounds[t])
            q.bounds[t] = -np.inf
            out = (*q.excluded, int(q.edges[t])) if t == q.split else (int(q.edges[t]),)
            node = int(np.searchsorted(start[: lattices.nodes + 1], q.edges[t], side="right")) - 1
            choices = [x for x in range(start[node], start[node + 1]) if x not in out]
            weights = np.cumsum(p[choices])
            u = float(uniform(mix(keys[i : i + 1] + U64(3 + 2 * r)), np.array([t]))[0]) * weights[-1]
            e = choices[min(int(np.searchsorted(weights, u)), len(choices) - 1)]
            unit = int(q.unit[t])
            a = ends[i] - sizes[i]
            count = 0
            if to[e] >= 0:
                nodes.append(np.array([to[e]]))
                o.append(np.array([unit]))
                count = 1
            nodes.append(roots[a + unit + 1 : ends[i]])
            o.append(np.arange(unit + 1, sizes[i]))
            count += sizes[i] - unit - 1
            d.append(np.full(count, i))
            todo.append((i, q, t, e, out, key, count))
        if not todo:
            break
        flat, per = fresh(np.concatenate(nodes), np.concatenate(d), np.concatenate(o), r)
        units_of = np.repeat(np.concatenate(o), per)
        done = np.cumsum(per)
        first, found = 0, []
        for i, q, t, e, out, key, count in todo:
            lo, hi = (done[first - 1] if first else 0), (done[first + count - 1] if first + count else 0)
            first += count
            path = np.concatenate([q.edges[:t], [e], flat[lo:hi]])
            found.append((i, paths[i], path, np.concatenate([q.unit[: t + 1], units_of[lo:hi]]), t, out, key))
        _finish(found, p, noise_keys[r], k)
    pieces = iter(lattices.v.expanded([code[q.edges] for have in paths for q in have]))
    made = []
    for have in paths:
        after = max((q.bounds.max(initial=-np.inf) for q in have), default=-np.inf)
        rows = []
        for q in have:
            rate = math.exp(min(q.total - after, 700.0)) if after > -np.inf else math.inf
            inclusion = 0.0 if rate > 40 else math.log(-math.expm1(-rate)) if rate > 1e-12 else q.total - after
            rows.append((next(pieces), q.total, inclusion))
        made.append(rows)
    return made


def _finish(found: list[tuple], p: np.ndarray, noise_keys: np.ndarray, k: int) -> None:
    """Put paths that are (text's number, its paths, edges, unit, split, excluded, key) to the paths of their texts."""
    for lo in range(0, len(found), 256):
        part = found[lo : lo + 256]
        starts = np.concatenate([[0], np.cumsum([len(x[2]) for x in part])])
        own = p[np.concatenate([x[2] for x in part])]
        logs = np.log(own)
        spare = np.ones(len(part))
        for j, (_, _, edges, _, split, excluded, _) in enumerate(part):
            if split < len(edges):
                spare[j] = 1.0 - sum(p[list(excluded)].tolist()) - float(own[starts[j] + split])
        split, key = np.array([x[4] for x in part]), np.array([x[6] for x in part])
        bounds = _bounds(logs, own, starts, split, spare, key, noise_keys[[x[0] for x in part]], k)
        for j, (_, have, edges, unit, at, excluded, its_key) in enumerate(part):
            here = slice(starts[j], starts[j + 1])
            have.append(Path(edges, unit, float(logs[here].sum()), at, excluded, its_key, bounds[here]))


_SHARED: dict[str, Lattices] = {}


def _lattices(digest: str, model: bytes) -> Lattices:
    if digest not in _SHARED:
        _SHARED.clear()
        _SHARED[digest] = Lattices(Vocabulary(model))
    return _SHARED[digest]


def encode_samples(docs: DataFrame, model_path: str = DEFAULT_MODEL, k: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """One row per text and sample: kept columns, sample (1 .. k), n_pieces, log_prob, log_inclusion, round_trip and, if wanted, ids."""
    with open(model_path, "rb") as f:  # a file of the driver; its bytes are broadcast
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    digest = xxhash.xxh3_64_hexdigest(sent.value)
    new = T.StructType().add("sample", "integer").add("n_pieces", "integer").add("log_prob", "double").add("log_inclusion", "double").add("round_trip", "boolean")
    if ids:
        new = new.add("ids", T.ArrayType(T.IntegerType()))
    names = [c for c in (keep if keep is not None else docs.columns) if c not in new.fieldNames()]
    schema = T.StructType([docs.schema[c] for c in names] + new.fields)
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        lattices = _lattices(digest, sent.value)
        for b in batches:
            step = max(1, int(b.num_rows * BLOCK_CHARS / max(b.column(width + 1).nbytes, 1)))
            for at in range(0, b.num_rows, step):
                yield part(b.slice(at, step), lattices)
        if lattices.edges > MOST_EDGES // 3:  # a worker that goes on to other stages keeps a small table only
            lattices.clear()
        trim()

    def part(b: pa.RecordBatch, lattices: Lattices) -> pa.RecordBatch:
        raw = binary_values(b.column(width + 1))
        at = [i for i, t in enumerate(raw) if t is not None]
        keys = np.fromiter((xxhash.xxh3_64_intdigest(x or "", seed) for x in b.column(width).to_pylist()), U64, b.num_rows)[at]
        found = sample_texts(lattices, [raw[i].decode("utf-8", "replace") for i in at], keys, k)
        rows, cols = [], [[] for _ in new.fields]
        flat: list[np.ndarray] = []
        for i, samples in zip(at, found):
            for n, (pieces, log_prob, inclusion) in enumerate(samples):
                rows.append(i)
                same = lattices.v.decode(pieces.tolist()) == raw[i]
                for out, value in zip(cols, (n + 1, len(pieces), log_prob, inclusion, same)):
                    out.append(value)
                flat.append(pieces)
        made = [pa.array(c, f.type) for c, f in zip(cols, _arrow(new))]
        if ids:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            values = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
            made[-1] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        kept = pa.RecordBatch.from_arrays(b.columns[:width], names=names).take(pa.array(rows, pa.int64())) if width else None
        return pa.RecordBatch.from_arrays([*(kept.columns if kept else []), *made], names=[*names, *new.fieldNames()])

    source = docs.select(*[docs[c] for c in names], *[F.col(c).cast("string").alias(n) for c, n in zip((id_col, text_col), spare(docs, "__key", "__text"))])
    return arrow_map(source, run, schema)


def _arrow(fields: T.StructType) -> pa.Schema:
    from lectern.llm.common import to_arrow

    return to_arrow(fields)


def decode_pieces(rows: DataFrame, model_path: str = DEFAULT_MODEL, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Append decoded text (null for null ids; bytes that are no UTF-8 become U+FFFD)."""
    with open(model_path, "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())
    digest = xxhash.xxh3_64_hexdigest(sent.value)
    names = [c for c in (keep if keep is not None else rows.columns) if c not in (ids_col, "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _lattices(digest, sent.value).v
        for b in batches:
            texts = [v.decode(x).decode("utf-8", "replace") if x is not None else None for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "decoded"])

    return arrow_map(rows.select(*names, ids_col), run, T.StructType([rows.schema[c] for c in names]).add("decoded", "string"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_samples(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2, keep=["doc_id"])
