"""Language-model scores from a hierarchical Pitman-Yor model.

Every context is a restaurant, every word that follows it a dish.  The customers of a dish sit at
tables, and each table is one customer of the same dish in the parent restaurant.  A restaurant
of two preceding words has that of the nearer word as its parent, and all of these share one
root, whose tables draw from a uniform choice among the known words and one sign for all others.
Contexts are the words themselves, as 64-bit hashes: there are as many restaurants as the corpus
has contexts, and none is shared by strangers.

Gibbs sweeps draw the tables of each dish anew, given everything else as the last sweep left it.
Given its parent's probability and the totals of its restaurant, a dish depends on nothing else.
So dishes are dealt out by word, with the whole chain of a word's dishes in one part, and are
sampled side by side.  Restaurants reach over all parts: every part sends the customers and
tables of its contexts to their buckets, where they are summed and sent back.  The predictive
probabilities of the sweeps after the first ones are averaged.

Tokens move once, packed in arrays by word, and are written.  Each sweep writes its tables and the
totals it met, and the next starts from there.  Words, pairs and triples that are a large part of
the corpus are spread over all parts; their counts and tables are joined through the driver (at
most ``1 / HOT`` of each kind can be so frequent).
"""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphmill.llm.common import mixed64, named, small_batches, text_bytes
from glyphmill.session import WorkTables, delete, new_path, written

SWEEPS, FIRST_KEPT = 4, 2
STRENGTH = 1.0
# A word, pair or triple with this share of the tokens is spread over all parts.
HOT = 1 / 1024
# Text that one part of the packed tokens comes from, and text that is read to find the hot and common words.
PART_BYTES, LAYOUT_BYTES = 6 << 20, 64 << 20
BATCH_ROWS = 1 << 15
# Words with a short code in packed tokens; all others are packed as their hash.
COMMON = (1 << 16) - 1
# Parts, and buckets of contexts, are moved in so many turns, of at least so many parts, so that only a share of a table stands in
# shuffle files as well.
WAVES, WAVE_PARTS = 5, 7
FILES = 1 << 15
# Up to so many customers of a dish a table holds the weights of its numbers of tables; beyond it, an
# integral of so many points is taken at so many numbers of tables.
STIRLING, _NODES, _STEPS = 1024, 48, 64
END, START = b"\n", b"\r"
_TRAIN = 1 << 15


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


START_HASH = _hashes([START])[0]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each stands once, and the place of every key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(keys)]
    place = np.empty(len(keys), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], place


def joined(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """One number for a key and the word before it: a pair from a word, a triple from a pair."""
    with np.errstate(over="ignore"):
        return mixed64(near ^ mixed64(far + np.uint64(1)))


def context1(v: np.ndarray) -> np.ndarray:
    """The restaurant of one preceding word."""
    return mixed64(~v)


def context2(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The restaurant of two preceding words, ``u`` before ``v``."""
    return joined(context1(v), u)


@dataclass
class Tokens:
    """Distinct words of a batch of texts, the start sign last, and their places in the texts, each closed by an end sign.

    ``v`` precedes a word, ``u`` precedes ``v``.
    """

    words: np.ndarray
    code: np.ndarray
    v: np.ndarray
    u: np.ndarray
    doc: np.ndarray


def tokens_of(texts: list[bytes]) -> Tokens:
    flat: list[bytes] = []
    counts = np.empty(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        own = text.lower().split()
        own.append(END)
        counts[k] = len(own)
        flat += own
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    words, code = _hashes([*coded.dictionary.to_pylist(), START]), np.asarray(coded.indices)
    starts = np.cumsum(counts) - counts
    v = np.empty_like(code)
    v[1:] = code[:-1]
    v[starts] = len(words) - 1
    u = np.empty_like(code)
    u[1:] = v[:-1]
    u[starts] = len(words) - 1
    return Tokens(words, code, v, u, np.repeat(np.arange(len(texts)), counts))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


_FOUND = "kind int, word long, v long, u long, n long"


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch: frequent words (kind 0), pairs (1) and triples (2), the most common words (3) and the number of tokens (4)."""
    for batch in _batches(batches):
        t = tokens_of(text_bytes(batch.column("text")))
        w, v, u = t.words[t.code], t.words[t.v], t.words[t.u]
        pairs = joined(w, v)
        none = np.zeros(1, dtype=np.uint64)
        out = [(np.array([4]), none, none, none, np.array([len(w)]))]
        for kind, keys in enumerate((w, pairs, joined(pairs, u))):
            _, first, place = distinct(keys)
            n = np.bincount(place)
            big = np.flatnonzero(n >= max(2, HOT / 2 * len(keys)))
            f = first[big]
            out.append((np.full(len(f), kind), w[f], v[f] * np.uint64(kind > 0), u[f] * np.uint64(kind > 1), n[big]))
        n = np.bincount(t.code, minlength=len(t.words))
        top = np.argsort(-n, kind="stable")[:COMMON]
        zero = np.zeros(len(top), dtype=np.uint64)
        out.append((np.full(len(top), 3), t.words[top], zero, zero, n[top]))
        kind, *keys, n = (np.concatenate(c) for c in zip(*out))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), *[pa.array(k.astype(np.uint64).view(np.int64)) for k in keys], pa.array(n.astype(np.int64))],
            ["kind", "word", "v", "u", "n"],
        )


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Layout:
    """Number of parts, words with a short code from the most common one on, and what is spread over all parts.

    ``hot`` are triples of word, word before and word before that; each triple brings its pair and each pair its word.
    """

    parts: int
    common: np.ndarray
    hot_words: np.ndarray
    hot_pairs: np.ndarray
    hot_triples: np.ndarray
    keys: list[np.ndarray] = field(init=False)
    parents: list[np.ndarray] = field(init=False)
    contexts: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        triples = self.hot_triples.reshape(-1, 3)
        pairs = np.unique(np.concatenate([self.hot_pairs.reshape(-1, 2), triples[:, :2]]), axis=0)
        words = np.unique(np.concatenate([self.hot_words, pairs[:, 0]]))
        key1, key2 = joined(pairs[:, 0], pairs[:, 1]), joined(joined(triples[:, 0], triples[:, 1]), triples[:, 2])
        pairs, triples = pairs[np.argsort(key1)], triples[np.argsort(key2)]
        self.ranks = np.argsort(self.common)
        self.keys = [words, np.sort(key1), np.sort(key2)]
        self.parents = [None, _find(words, pairs[:, 0]), _find(self.keys[1], joined(triples[:, 0], triples[:, 1]))]
        self.contexts = [None, context1(pairs[:, 1]), context2(triples[:, 1], triples[:, 2])]
        self.hot_contexts = np.unique(np.concatenate(self.contexts[1:]))

    def bucket(self, contexts: np.ndarray) -> np.ndarray:
        """Buckets of restaurants, in the order of the keys."""
        return ((contexts >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)

    def short(self, words: np.ndarray) -> np.ndarray:
        """Short codes, ``COMMON`` for words that have none."""
        at = _find(self.common[self.ranks], words)
        return np.where(at < 0, COMMON, self.ranks[at] if len(self.ranks) else 0).astype("<u2")

    def long(self, codes: np.ndarray, rest: bytes) -> np.ndarray:
        at = np.frombuffer(codes, "<u2")
        out = np.empty(len(at), dtype=np.uint64)
        there = at < COMMON
        out[there] = self.common[at[there]]
        out[~there] = np.frombuffer(rest, "<u8")
        return out


def find_layout(rows: DataFrame, size: int, parts: int) -> Layout:
    """Hot and common words of a bounded sample: they decide where tokens go and how they are packed, not what comes out."""
    seen = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(min(1.0, LAYOUT_BYTES / max(1, size)) * (1 << 20)))
    with WorkTables(rows.sparkSession) as work:
        found = work.write(seen.select("text").mapInArrow(_frequent, _FOUND).groupBy("kind", "word", "v", "u").agg(F.sum("n").alias("n")), "lm-layout")
        total = found.where("kind = 4").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        top = found.where((F.col("kind") < 3) & (F.col("n") >= max(2, total * HOT))).collect()
        common = found.where("kind = 3 and n > 1").orderBy(F.desc("n"), "word").limit(COMMON).select("word").toArrow()
    as_u64 = lambda x: np.array(x, dtype=np.int64).view(np.uint64)
    return Layout(
        parts,
        np.asarray(common.column("word").combine_chunks()).astype(np.int64).view(np.uint64),
        as_u64([r.word for r in top if r.kind == 0]),
        as_u64([x for r in top if r.kind == 1 for x in (r.word, r.v)]),
        as_u64([x for r in top if r.kind == 2 for x in (r.word, r.v, r.u)]),
    )


def _pressed(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def _opened(x: bytes) -> bytes:
    return pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of one rank side by side, compressed: most of the upper ones are zero."""
    return _pressed(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _of_planes(x: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(_opened(x), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


_CHUNK = ["base", "w", "n", "v", "vr", "u", "ur", "d"]
_PACKED = "part int, base long, w binary, n binary, v binary, vr binary, u binary, ur binary, d binary"


def _unpacked_chunk(row: dict) -> dict:
    """A chunk's arrays as they were before they were pressed."""
    steps = _of_planes(row["v"], 2)
    own = {"n": _of_planes(row["n"], 4), "v": np.cumsum(steps, dtype="<u2"), "u": _of_planes(row["u"], 2), "d": _of_planes(row["d"], 2)}
    return row | own


def _order(part: np.ndarray, parts: int, code: np.ndarray, codes: int, near: np.ndarray) -> np.ndarray:
    """Places by part, word and the code of the word before."""
    if parts * codes < 1 << 47:
        return np.argsort((part * codes + code) << 16 | near)
    return np.lexsort((near, code, part))


def _packed(layout):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of a batch by part: distinct words, how often each occurs, and what stands before each and its document in that order."""
        own = layout.value
        for batch in _batches(batches):
            t = tokens_of(text_bytes(batch.column("text")))
            row = np.asarray(batch.column("row"))
            train = np.asarray(batch.column("train").cast(pa.int8())).astype(bool)
            key = t.words[t.code]
            # What is hot is told apart by one more word, at last by the batch.
            hot = np.flatnonzero((_find(own.keys[0], t.words) >= 0)[t.code])
            for level, more in enumerate((t.v, t.u, None)):
                if level:
                    hot = hot[_find(own.keys[level], key[hot]) >= 0]
                key[hot] = joined(key[hot], t.words[more[hot]] if level < 2 else np.full(len(hot), row[0], dtype=np.uint64))
            part = (mixed64(key) % np.uint64(own.parts)).astype(np.int64)
            short = own.short(t.words)
            # Sorted by the word before as well, so that its codes rise and can be packed as steps.
            order = _order(part, own.parts, t.code, len(t.words), short[t.v])
            part, code, v, u = part[order], t.code[order], t.v[order], t.u[order]
            d = (t.doc | np.where(train, _TRAIN, 0)[t.doc])[order].astype("<u2")
            runs = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (code[1:] != code[:-1]))))
            sizes = np.diff(np.append(runs, len(code))).astype("<u4")
            words, run_part = t.words[code[runs]], part[runs]
            cuts = np.flatnonzero(np.concatenate(([True], run_part[1:] != run_part[:-1], [True])))
            at = np.append(runs, len(code))
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                s = slice(at[a], at[b])
                near, far = short[v[s]], short[u[s]]
                rest = (t.words[x[s][codes == COMMON]].tobytes() for x, codes in ((v, near), (u, far)))
                arrays = (words[a:b].tobytes(), _planes(sizes[a:b]), _planes(np.diff(near, prepend=near[:1] * 0)), next(rest), _planes(far), next(rest), _planes(d[s]))
                rows.append((int(run_part[a]), int(row[0]), *arrays))
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 7)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["part", *_CHUNK])

    return pack


@dataclass
class State:
    """What the driver knows: counts, and per sweep the totals and hot dishes that the next one needs."""

    layout: Layout
    seed: int
    tokens: int = 0
    known: int = 0
    # Of the root, of contexts of one word and of two.
    discount: list[float] = field(default_factory=lambda: [0.5, 0.5, 0.5])
    word_counts: np.ndarray = None
    triple_counts: np.ndarray = None
    # One entry per sweep, the first before any: customers of hot words and pairs, and tables of hot words, pairs and triples.
    hot_customers: list[list[np.ndarray]] = field(default_factory=list)
    hot_tables: list[list[np.ndarray]] = field(default_factory=list)
    root_customers: list[float] = field(default_factory=list)
    root_tables: list[float] = field(default_factory=list)

    def root(self, sweep: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The root's probability of words with these customers and tables."""
        d, t = self.discount[0], self.root_tables[sweep]
        return (customers - d * tables + (STRENGTH + d * t) / (self.known + 1)) / (STRENGTH + self.root_customers[sweep])

    def predictive(self, level: int, customers, tables, all_customers, all_tables, parent) -> np.ndarray:
        d = self.discount[level]
        return (customers - d * tables + (STRENGTH + d * all_tables) * parent) / (STRENGTH + all_customers)


@lru_cache(maxsize=4)
def _stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ``[n, t]`` sums over the seatings of n customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    at = np.arange(most + 1)
    with np.errstate(divide="ignore"):
        for n in range(most):
            out[n + 1, 1 : n + 2] = np.logaddexp(out[n, : n + 1], np.log(np.maximum(n - discount * at[1 : n + 2], 0)) + out[n, 1 : n + 2])
    return out


def _log_ratio(n: np.ndarray, d: float, y: np.ndarray) -> np.ndarray:
    """Number of tables whose saddle point is at ``y``, as a logarithm."""
    return np.log(n / d) + np.log(-np.expm1(d * np.log(y))) - (d - 1) * np.log(y) - np.log1p(-y)


def _large_stirling(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """The same for many customers, without the factor n! / discount**t, by an integral over a parabola.

    The numbers are the coefficients of ``(1 - (1 - x)**d)**t / t!``; the path goes through the saddle
    point, or at six n-ths from the branch point at 1 where the saddle is nearer.
    """
    n, t, d = customers.astype(np.float64), tables.astype(np.float64), discount
    low, high = np.full(len(t), -400.0), np.full(len(t), -1e-12)
    for _ in range(50):
        mid = (low + high) / 2
        right = np.log(t * d / n) + (d - 1) * mid - np.log(-np.expm1(d * mid)) + np.log(-np.expm1(mid)) > 0
        low, high = np.where(right, mid, low), np.where(right, high, mid)
    y = np.maximum(np.exp(high), 6 / n)
    bend = n / (1 - y) ** 2 + t * d * y ** (d - 2) * ((1 - d) * (1 - y**d) - d * y**d) / (1 - y**d) ** 2
    width = np.minimum(1.0, 0.5 / (y * np.sqrt(np.maximum(bend, 0.25 / y**2))))[:, None]
    ends = np.arcsinh(4 / width)
    v = ends * np.arange(_NODES) / (_NODES - 1)
    u = width * np.sinh(v)
    z = y[:, None] * (1 + 1j * u) ** 2
    phi = t[:, None] * np.log(1 - z**d) - (n[:, None] + 1) * np.log(1 - z)
    top = phi[:, :1].real
    value = (np.exp(phi - top) * (1 + 1j * u)).real * width * np.cosh(v) * ends
    value = np.abs(value.sum(1) - value[:, 0] / 2)
    found = top[:, 0] + np.log(value * 2 * y / (np.pi * (_NODES - 1)))
    return np.where(t == n, n * math.log(d), found) - _lgamma(t + 1)


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x.ravel()), dtype=np.float64, count=x.size).reshape(x.shape)


def _seat_large(customers: np.ndarray, others: np.ndarray, probability: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """One draw for each dish with many customers.

    The weights are largest where a further table weighs as much as none; they are taken at even steps
    over eight standard deviations on both sides, at every number where there are few.
    """
    n, d, start = customers.astype(np.float64), discount, (STRENGTH + discount * others) / discount

    def slope(log_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.exp(log_y)
        t = np.exp(_log_ratio(n, d, y))
        return np.log(-np.expm1(d * log_y)) + np.log(probability) + np.log(start + t) - np.log(t + 1), t

    low, high = np.full(len(n), -300.0), np.full(len(n), -1e-9)
    for _ in range(60):
        mid = (low + high) / 2
        up = slope(mid)[0] > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    (s0, t0), (s1, t1) = slope(high * 1.0001), slope(high * 0.9999)
    best = np.clip(slope(high)[1], 1, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.sqrt(np.nan_to_num((t1 - t0) / np.maximum(s0 - s1, 1e-300), nan=1.0, posinf=1.0))
    spread = np.clip(spread, 1.0, n)
    first = np.floor(np.maximum(1, best - 8 * spread - 12))
    tail = np.minimum(n**d, 1 / np.maximum(-np.log(probability), 1e-12))
    last = np.ceil(np.minimum(n, best + 8 * spread + 24 + 20 * tail))
    at = np.rint(first[:, None] + (last - first)[:, None] * np.linspace(0, 1, _STEPS))
    every = first[:, None] + np.arange(_STEPS)
    at = np.where((last - first < _STEPS)[:, None], np.minimum(every, last[:, None]), at)
    flat = _large_stirling(np.repeat(customers, _STEPS), at.ravel(), discount).reshape(at.shape)
    weight = flat + at * np.log(probability)[:, None] + _lgamma(start[:, None] + at)
    # Each number stands for those up to half way to its neighbours, a repeated one for none.
    middle = np.floor((at[:, 1:] + at[:, :-1] + 1) / 2)
    edges = np.concatenate([at[:, :1], middle, at[:, -1:] + 1], axis=1)
    repeated = np.concatenate([np.zeros((len(at), 1), dtype=bool), at[:, 1:] == at[:, :-1]], axis=1)
    edges[:, :-1] = np.where(repeated, at + 1, edges[:, :-1])
    mass = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)) * np.diff(edges, axis=1), axis=1)
    k = np.minimum((mass < (rng.random(len(n)) * mass[:, -1])[:, None]).sum(axis=1), _STEPS - 1)
    own = np.arange(len(n))
    return np.floor(edges[own, k] + rng.random(len(n)) * (edges[own, k + 1] - edges[own, k]))


def seat(customers: np.ndarray, others: np.ndarray, probability: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn from their distribution given all else.

    ``others`` are the tables of the other dishes in the restaurant, ``probability`` the parent's.
    A dish of n customers has t tables with a weight of the generalised Stirling number of n and t
    times, for each table, the parent's probability and the restaurant's weight of a further table.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    large = np.flatnonzero(customers > STIRLING)
    for at in range(0, len(large), 64):
        k = large[at : at + 64]
        tables[k] = _seat_large(customers[k], others[k], probability[k], discount, rng)
    left = np.flatnonzero((customers > 1) & (customers <= STIRLING))
    left = left[np.argsort(customers[left], kind="stable")]
    numbers = _stirling(discount, STIRLING) if len(left) else None
    sizes = customers[left]
    at = 0
    while at < len(left):
        # Dishes of about the same size together: as many as a bounded table holds.
        n = int(sizes[at])
        end = int(np.searchsorted(sizes, max(n, n * 5 // 4), side="right"))
        end = min(end, at + max(1, (1 << 18) // (n * 5 // 4)))
        own = left[at:end]
        most = int(customers[own[-1]])
        further = STRENGTH + discount * (others[own][:, None] + np.arange(most))
        weight = np.cumsum(np.log(further * probability[own][:, None]), axis=1) + numbers[customers[own], 1 : most + 1]
        mass = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        tables[own] = 1 + (mass < (rng.random(len(own)) * mass[:, -1])[:, None]).sum(axis=1)
        at = end
    return tables


class Part:
    """The dishes of one part: words at the root, pairs in the restaurants of one word, triples in those of two."""

    def __init__(self, number: int, chunks: list[dict], layout: Layout):
        self.number, self.layout = number, layout
        self.words, _, code = distinct(np.concatenate([np.frombuffer(c["w"], "<u8") for c in chunks]))
        code = np.repeat(code, np.concatenate([np.frombuffer(c["n"], "<u4") for c in chunks]))
        v = np.concatenate([layout.long(c["v"], c["vr"]) for c in chunks])
        u = np.concatenate([layout.long(c["u"], c["ur"]) for c in chunks])
        train = np.concatenate([np.frombuffer(c["d"], "<u2") for c in chunks]) >= _TRAIN
        pair = joined(self.words[code], v)
        keys2, first, self.triple = distinct(joined(pair, u))
        keys1, of_pair, self.pair_of = distinct(pair[first])
        some = first[of_pair]
        self.word_of = code[some]
        contexts = np.concatenate([context1(v[some]), context2(v[first], u[first])])
        del pair, u, v
        self.contexts, _, at = distinct(contexts)
        self.context = [None, at[: len(some)], at[len(some) :]]
        self.one_word = np.zeros(len(self.contexts), dtype=bool)
        self.one_word[self.context[1]] = True
        self.hot = [_find(table, keys) for table, keys in zip(layout.keys, (self.words, keys1, keys2))]
        self.hot_context = _find(layout.hot_contexts, self.contexts)
        self.word_count = np.bincount(code[train], minlength=len(self.words)).astype(np.float64)
        self.triple_count = np.bincount(self.triple[train], minlength=len(keys2)).astype(np.float64)
        self.chunks = chunks

    def start(self) -> None:
        """Each dish begins with one table; what is hot is counted by the driver."""
        self.count, self.tables = self.triple_count, [None, None, None]
        self.tables[2] = np.minimum(self.count, 1)
        self.customers = [None, np.bincount(self.pair_of, np.where(self.hot[2] < 0, self.tables[2], 0), len(self.word_of))]
        self.tables[1] = np.minimum(self.customers[1], 1)
        self.customers[0] = np.bincount(self.word_of, np.where(self.hot[1] < 0, self.tables[1], 0), len(self.words))
        self.tables[0] = np.minimum(self.customers[0], 1)

    def resume(self, state: State, sweep: int, tables: list[np.ndarray]) -> None:
        """The dishes as ``sweep`` left them."""
        self.count, self.tables, self.customers = self.triple_count.copy(), [t.astype(np.float64) for t in tables], [None, None]
        for level, hot in enumerate(self.hot):
            there = hot >= 0
            self.tables[level][there] = state.hot_tables[sweep][level][hot[there]]
        there = self.hot[2] >= 0
        self.count[there] = state.triple_counts[self.hot[2][there]]
        for level, of in ((1, self.pair_of), (0, self.word_of)):
            self.customers[level] = np.bincount(of, self.tables[level + 1], len(self.tables[level]))
            there = self.hot[level] >= 0
            self.customers[level][there] = state.hot_customers[sweep][level][self.hot[level][there]]

    def totals(self, before: tuple[np.ndarray, np.ndarray] | None, active: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of all contexts, of which only the active ones were sent."""
        if before is None:
            return active
        out = tuple(x.copy() for x in before)
        at = self.active(before)
        for x, new in zip(out, active):
            x[at] = new
        return out

    def active(self, totals: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Contexts whose totals may change: a restaurant of two words with one customer at most keeps its table."""
        return np.ones(len(self.contexts), dtype=bool) if totals is None else self.one_word | (totals[0] > 1)

    def probabilities(self, state: State, sweep: int, totals: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Of words at the root, and of pairs and triples, as ``sweep`` left them."""
        out = [state.root(sweep, self.customers[0], self.tables[0])]
        for level, of, customers in ((1, self.word_of, self.customers[1]), (2, self.pair_of, self.count)):
            c, t = (x[self.context[level]] for x in totals)
            out.append(state.predictive(level, customers, self.tables[level], c, t, out[-1][of]))
        return out

    def sweep(self, state: State, sweep: int, totals: tuple[np.ndarray, np.ndarray]) -> None:
        """Reseat every dish that is not hot, from the state after ``sweep - 1``."""
        rng = np.random.default_rng([state.seed, sweep, self.number])
        p = self.probabilities(state, sweep - 1, totals)
        for level, of in ((2, self.pair_of), (1, self.word_of), (0, None)):
            customers = self.count if level == 2 else self.customers[level]
            own = np.flatnonzero((self.hot[level] < 0) & (customers > 0))
            old = self.tables[level]
            new = np.zeros(len(old))
            if level:
                others, parent = totals[1][self.context[level][own]] - old[own], p[level - 1][of[own]]
            else:
                others, parent = state.root_tables[sweep - 1] - old[own], np.full(len(own), 1 / (state.known + 1))
            new[own] = seat(customers[own].astype(np.int64), np.maximum(others, 0), parent, state.discount[level], rng)
            self.tables[level] = new
            if level:
                # The customers of what is hot come from the driver, after the sweep.
                self.customers[level - 1] = np.bincount(of, np.where(self.hot[level] < 0, new, 0), len(self.tables[level - 1]))

    def sums(self, tables: np.ndarray) -> np.ndarray:
        """What the driver adds up, without the hot dishes themselves; ``tables`` are those of the contexts."""
        plain = [h < 0 for h in self.hot]
        customers = [self.customers[0], self.customers[1], self.count]
        scalars = [self.word_count.sum(), np.count_nonzero(self.word_count[plain[0]]), self.tables[1][plain[1]].sum(), self.tables[0][plain[0]].sum()]
        for level in range(3):
            scalars += [np.count_nonzero(customers[level][plain[level]] == n) for n in (1, 2)]

        def of(hot: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
            return np.bincount(hot[hot >= 0], values[hot >= 0], n)

        sizes = [len(k) for k in self.layout.keys]
        hot = [of(self.hot[0], self.word_count, sizes[0])] + [of(self.hot[k], customers[k], sizes[k]) for k in range(3)]
        return np.concatenate([scalars, *hot, of(self.hot_context, tables, len(self.layout.hot_contexts))]).astype(np.float64)

    def context_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of this part's dishes in each context."""
        out = np.zeros((2, len(self.contexts)))
        for level, customers in ((1, self.customers[1]), (2, self.count)):
            plain = self.hot[level] < 0
            at = self.context[level][plain]
            out[0] += np.bincount(at, customers[plain], len(self.contexts))
            out[1] += np.bincount(at, self.tables[level][plain], len(self.contexts))
        return out[0], out[1]


# Rows of a sweep: the tables of a part's dishes, its sums by bucket of contexts, sums for the driver, and the totals it met.
TABLES, CONTEXTS, SUMS, MET, TOTALS = range(5)
_ROWS = "kind int, sweep int, part int, bucket int, keys binary, a binary, b binary, c binary, sums array<double>"
_NAMES = ["kind", "sweep", "part", "bucket", "keys", "a", "b", "c", "sums"]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (*[pa.int32()] * 4, *[pa.binary()] * 4, pa.list_(pa.float64()))
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=_NAMES)


def _ints(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, after their width."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or x.max() < 1 << 8 * w - (w == 8))
    return bytes([width]) + _planes(np.rint(x).astype(f"<u{width}"))


def _floats(x: bytes) -> np.ndarray:
    return _of_planes(x[1:], x[0]).astype(np.float64)


def _keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their steps."""
    return _planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def _keys_of(x: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(x, 8), dtype=np.uint64)


def _history(part: Part, rows: list[dict], last: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Totals of a part's contexts after each sweep that the rows know, the last one from what its buckets sent."""
    met = {r["sweep"]: (_floats(r["a"]), _floats(r["b"])) for r in rows if r["kind"] == MET}
    sent = sorted((r for r in rows if r["kind"] == TOTALS), key=lambda r: r["bucket"])
    new = tuple(np.concatenate([_floats(r[c]) for r in sent]) if sent else np.empty(0) for c in ("a", "b"))
    return met | {last: part.totals(met.get(last - 1), new)}


def _tables(rows: list[dict]) -> dict[int, list[np.ndarray]]:
    return {r["sweep"]: [_floats(r["a"]), _floats(r["b"]), _floats(r["c"])] for r in rows if r["kind"] == TABLES}


def _part(tokens: pa.Table, layout: Layout) -> Part | None:
    chunks = [_unpacked_chunk(r) for r in tokens.sort_by("base").to_pylist()]
    return Part(chunks[0]["part"], chunks, layout) if chunks else None


def _swept(part: Part, state: State, sweep: int, rows: list[dict]) -> list[tuple]:
    out, met = [], None
    if sweep:
        met = _history(part, rows, sweep - 1)[sweep - 1]
        part.resume(state, sweep - 1, _tables(rows)[sweep - 1])
        part.sweep(state, sweep, met)
        out.append((MET, sweep - 1, part.number, None, None, _ints(met[0]), _ints(met[1]), None, None))
    else:
        part.start()
    out.append((TABLES, sweep, part.number, None, None, *map(_ints, part.tables), None))
    customers, tables = part.context_sums()
    out.append((SUMS, sweep, part.number, None, None, None, None, None, part.sums(tables).tolist()))
    active = part.active(met)
    keys, customers, tables = part.contexts[active], customers[active], tables[active]
    bucket = part.layout.bucket(keys)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keys) else np.zeros(1, dtype=int)
    for a, b in zip(cuts, cuts[1:]):
        out.append((CONTEXTS, sweep, part.number, int(bucket[a]), _keys(keys[a:b]), _ints(customers[a:b]), _ints(tables[a:b]), None, None))
    return out


def _total(group: pa.Table) -> pa.Table:
    """Of one bucket: each part gets the totals of the contexts that it sent, in its order."""
    rows = group.to_pylist()
    keys = [_keys_of(r["keys"]) for r in rows]
    sizes = [len(k) for k in keys]
    at = distinct(np.concatenate(keys))[2]
    sums = [np.bincount(at, np.concatenate([_floats(r[c]) for r in rows]))[at] for c in ("a", "b")]
    ends = np.cumsum(sizes)
    return _table(
        [(TOTALS, r["sweep"], r["part"], r["bucket"], None, _ints(sums[0][e - n : e]), _ints(sums[1][e - n : e]), None, None) for r, n, e in zip(rows, sizes, ends) if r["part"] >= 0]
    )


def _free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of queries that have ended, which nothing refers to any more.

    It waits for a collection on the driver, which a driver that holds little else may not have for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Fit:
    """A fitted model: packed tokens in files by part, and what each sweep wrote."""

    def __init__(self, work: WorkTables, rows: DataFrame, layout: Layout, seed: int):
        self.work = work
        self.spark, self.layout, self.state = rows.sparkSession, layout, State(layout, seed)
        self.sweeps: list[DataFrame] = []
        self.paths: list[str] = []
        # Parts, and buckets, of each turn.
        waves = max(1, min(WAVES, layout.parts // WAVE_PARTS))
        ends = [k * layout.parts // waves for k in range(waves + 1)]
        self.waves = list(zip(ends, ends[1:]))
        self.name, self.path = f"glyphmill_lm_{uuid.uuid4().hex}", new_path(self.spark, "lm-tokens")
        # Once for all turns: a function that holds it would leave a copy on the driver's disk each time.
        self.shared = self.spark.sparkContext.broadcast(layout)
        packed = rows.select("row", "train", "text").mapInArrow(_packed(self.shared), _PACKED)
        sent = work.write(packed.withColumn("wave", self.wave("part")), "lm-packed", "wave")
        sent_path, self.tables = work.paths[-1], []
        for wave, (first, end) in enumerate(self.waves):
            files = min(end - first, FILES)
            # Files by part, so that no sweep has to move the tokens again.
            own = sent.where(F.col("wave") == wave).drop("wave").repartition(files, "part").sortWithinPartitions("part")
            out = own.write.bucketBy(files, "part").sortBy("part")
            out.option("path", f"{self.path}/{wave}").option("compression", "zstd").saveAsTable(f"{self.name}_{wave}")
            del own, out
            work.drop_rows(sent_path, f"wave={wave}")
            _free_shuffles(self.spark)
            self.tables.append(self.spark.table(f"{self.name}_{wave}"))
        work.drop(sent_path)

    @property
    def tokens(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.tables)

    def drop(self) -> None:
        for wave in range(len(self.waves)):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{wave}")
        delete(self.spark, self.path)

    def wave(self, number: str) -> Column:
        """The turn of a part or bucket."""
        turn = F.lit(None)
        for wave, (_, end) in reversed(list(enumerate(self.waves))):
            turn = F.when(F.col(number) < end, wave).otherwise(turn)
        return turn.cast("int")

    def over_parts(self, function, right: DataFrame | None, schema: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
        """``function`` of each part and of the rows of earlier sweeps that belong to it, written."""
        path = None
        for tokens, (first, end) in zip(self.tables, self.waves):
            own = None if right is None else right.where(F.col("part").between(first, end - 1)).repartition(min(end - first, FILES), "part")
            found = self._over(function, tokens, own, schema)
            out = self.work.write(found.withColumn("wave", self.wave("bucket")) if by else found, label, by, path)
            path = path or self.work.paths[-1]
            del own, found
            _free_shuffles(self.spark)
        return out

    def _over(self, function, own: DataFrame, right: DataFrame | None, schema: str) -> DataFrame:
        layout = self.shared

        def alone(tokens: pa.Table) -> pa.Table:
            return function(_part(tokens, layout.value), [])

        def both(tokens: pa.Table, rows: pa.Table) -> pa.Table:
            return function(_part(tokens, layout.value), rows.to_pylist())

        own = own.groupBy("part")
        if right is None:
            return own.applyInArrow(alone, schema)
        return own.cogroup(right.groupBy("part")).applyInArrow(both, schema)

    def met(self, sweep: int) -> DataFrame:
        """The totals of contexts after a sweep, for the parts that know them, written; what the parts sent for them is given back on the way."""
        hot, path, sent = self.hot_sums(sweep), None, self.sweeps[sweep].where(F.col("kind") == CONTEXTS)
        for wave, (first, end) in enumerate(self.waves):
            own = sent.where(F.col("wave") == wave).drop("wave")
            more = [r for r in hot if first <= r[3] < end]
            if more:
                own = own.unionByName(self.spark.createDataFrame(more, own.schema))
            totals = self.work.write(own.repartition(min(end - first, FILES), "bucket").groupBy("bucket").applyInArrow(_total, _ROWS), "lm-totals", (), path)
            path = path or self.work.paths[-1]
            del own
            self.work.drop_rows(self.paths[sweep], f"kind={CONTEXTS}/wave={wave}")
            _free_shuffles(self.spark)
        self.work.drop_rows(self.paths[sweep], f"kind={CONTEXTS}")
        return totals

    def hot_sums(self, sweep: int) -> list[tuple]:
        """The hot dishes' share in their contexts, as rows of a part of its own."""
        state, layout, out = self.state, self.layout, []
        for level, customers in ((1, state.hot_customers[sweep][1]), (2, state.triple_counts)):
            tables, keys = state.hot_tables[sweep][level], layout.contexts[level]
            for key, bucket, c, t in zip(keys, layout.bucket(keys), customers, tables):
                out.append((CONTEXTS, sweep, -1, int(bucket), _keys(np.array([key])), _ints(np.array([c])), _ints(np.array([t])), None, None))
        return out

    def sweep(self, sweep: int) -> None:
        work, state, layout = self.work, self.state, self.layout
        rng = np.random.default_rng([state.seed, sweep])
        if sweep:
            # Hot triples are drawn before their sweep, hot pairs and words from what it adds up.
            old, customers = state.hot_tables[-1], state.hot_customers[-1]
            root = state.root(sweep - 1, customers[0], old[0])
            at = _find(layout.hot_contexts, layout.contexts[1])
            pair_others, pair_parent = self.context_tables[at] - old[1], root[layout.parents[1]]
            pair = state.predictive(1, customers[1], old[1], self.context_customers[at], self.context_tables[at], pair_parent)
            at = _find(layout.hot_contexts, layout.contexts[2])
            tables2 = seat(state.triple_counts.astype(np.int64), np.maximum(self.context_tables[at] - old[2], 0), pair[layout.parents[2]], state.discount[2], rng)
        shared = self.spark.sparkContext.broadcast(state)

        def run(part: Part, rows: list[dict]) -> pa.Table:
            return _table(_swept(part, shared.value, sweep, rows) if part else [])

        right = None
        if sweep:
            totals = self.met(sweep - 1)
            met = work.paths[-1]
            right = self.sweeps[-1].where(F.col("kind").isin(TABLES, MET)).drop("wave").unionByName(totals)
            del totals
        self.sweeps.append(self.over_parts(run, right, _ROWS, "lm-sweep", ("kind", "wave")))
        self.paths.append(work.paths[-1])
        del right
        if sweep:
            work.drop(met)
        found = self.sweeps[-1].where(F.col("kind") == SUMS).select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("sum")).orderBy("pos")
        sums = np.asarray(found.toArrow().column("sum").combine_chunks()).astype(np.float64)
        n0, n1, n2 = (len(k) for k in layout.keys)
        scalars, words, customers0, customers1, counts, contexts = np.split(sums if len(sums) else np.zeros(10 + 2 * n0 + n1 + n2 + len(layout.hot_contexts)), np.cumsum([10, n0, n0, n1, n2]))
        if not sweep:
            state.word_counts, state.triple_counts = words, counts
            state.tokens, state.known = int(scalars[0]), int(scalars[1]) + int(np.count_nonzero(words))
            state.discount = [_discount(*scalars[4 + 2 * k : 6 + 2 * k]) for k in range(3)]
            tables2 = np.minimum(counts, 1)
        np.add.at(customers1, layout.parents[2], tables2)
        tables1 = seat(customers1.astype(np.int64), np.maximum(pair_others, 0), pair_parent, state.discount[1], rng) if sweep else np.minimum(customers1, 1)
        np.add.at(customers0, layout.parents[1], tables1)
        if sweep:
            tables0 = seat(customers0.astype(np.int64), state.root_tables[-1] - old[0], np.full(n0, 1 / (state.known + 1)), state.discount[0], rng)
        else:
            tables0 = np.minimum(customers0, 1)
        state.hot_customers.append([customers0, customers1])
        state.hot_tables.append([tables0, tables1, tables2])
        state.root_customers.append(float(scalars[2] + tables1.sum()))
        state.root_tables.append(float(scalars[3] + tables0.sum()))
        # Totals of the hot dishes' contexts: the parts' tables and those drawn here.
        self.context_tables = contexts
        for level, tables in ((1, tables1), (2, tables2)):
            np.add.at(self.context_tables, _find(layout.hot_contexts, layout.contexts[level]), tables)
        self.context_customers = self.customers_of_hot_contexts(sweep)

    def customers_of_hot_contexts(self, sweep: int) -> np.ndarray:
        keys = self.layout.hot_contexts

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, customers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at = _find(keys, _keys_of(own))
                    there = at >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(at[there], pa.int32()), pa.array(_floats(customers)[there])], ["at", "n"])

        sent = self.sweeps[sweep].where(F.col("kind") == CONTEXTS).select("keys", "a")
        out = np.zeros(len(keys))
        if len(keys):
            found = sent.mapInArrow(some, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
            out[np.asarray(found.column("at").combine_chunks())] = np.asarray(found.column("n").combine_chunks())
        for key, customers in ((1, self.state.hot_customers[sweep][1]), (2, self.state.triple_counts)):
            np.add.at(out, _find(keys, self.layout.contexts[key]), customers)
        return out

    def kept(self, first: int) -> DataFrame:
        """What the parts need to know the probabilities after the sweeps from ``first`` on."""
        last = len(self.sweeps) - 1
        out = self.met(last)
        for k in range(first, last + 1):
            kinds = (TABLES, MET) if k > min(first, last - 1) else (TABLES,)
            out = out.unionByName(self.sweeps[k].where(F.col("kind").isin(*kinds)).drop("wave"))
        return out


def _discount(once: float, twice: float) -> float:
    """From the dishes with one and with two customers, as in Kneser-Ney smoothing."""
    return float(min(0.95, max(0.05, once / (once + 2 * twice)))) if once else 0.5


def fit(work: WorkTables, rows: DataFrame, layout: Layout, seed: int, sweeps: int, first_kept: int) -> Fit:
    """The model of ``row, train, text`` after Gibbs sweeps; its tokens are there until ``drop``."""
    model = Fit(work, rows, layout, seed)
    for k in range(sweeps + 1):
        model.sweep(k)
        if 2 <= k < 2 + min(first_kept, sweeps - 1):
            # The totals that the sweep before it met are known no longer than that.
            work.drop_rows(model.paths[k - 1], f"kind={MET}")
        if 0 < k <= first_kept:
            # Nothing reads the sweep before this one any more.
            work.drop()
    return model


def averaged(part: Part, state: State, rows: list[dict], first_kept: int) -> np.ndarray:
    """Mean probability of each triple over the kept sweeps."""
    last = len(state.root_tables) - 1
    totals, tables = _history(part, rows, last), _tables(rows)
    mean = np.zeros(len(part.triple_count))
    for k in range(first_kept, last + 1):
        part.resume(state, k, tables[k])
        mean += part.probabilities(state, k, totals[k])[2]
    return mean / (last + 1 - first_kept)


def _score_part(shared, first_kept: int):
    def run(part: Part, rows: list[dict]) -> pa.Table:
        """Per batch of documents: the documents met, and their sums over this part's tokens."""
        out = []
        if part:
            state = shared.value
            floor = math.log10(state.tokens + state.known + 1)
            counts, there = part.word_count.copy(), part.hot[0] >= 0
            counts[there] = state.word_counts[part.hot[0][there]]
            score = np.log10(averaged(part, state, rows, first_kept))[part.triple]
            code = part.word_of[part.pair_of[part.triple]]
            base, known = (np.log10(counts + 1) - floor)[code], (counts > 0)[code]
            at = 0
            for chunk in part.chunks:
                d = np.frombuffer(chunk["d"], "<u2") & (_TRAIN - 1)
                own = slice(at, at + len(d))
                at += len(d)
                n = np.bincount(d)
                docs = np.flatnonzero(n)
                s, b, k = (np.bincount(d, x[own])[docs] for x in (score, base, known))
                out.append((chunk["base"], part.number, docs.astype("<u2").tobytes(), s.tobytes(), b.tobytes(), _ints(k), _ints(n[docs])))
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
        return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["base", "part", "d", "s", "b", "k", "n"])

    return run


def _unpacked(chunks: pa.Table) -> pa.Table:
    """Sums of one batch of documents over all parts."""
    rows = chunks.sort_by("part").to_pylist()
    docs, where = np.unique(np.concatenate([np.frombuffer(r["d"], "<u2") for r in rows]), return_inverse=True)

    def total(name: str, of=lambda x: np.frombuffer(x, "<f8")) -> np.ndarray:
        return np.bincount(where, np.concatenate([of(r[name]) for r in rows]), len(docs))

    return pa.table(
        {
            "_row": pa.array(docs.astype(np.int64) + rows[0]["base"]),
            "score": total("s"),
            "base_score": total("b"),
            "n_known": pa.array(total("k", _floats).astype(np.int64)),
            "n_tokens": pa.array(total("n", _floats).astype(np.int64)),
        }
    )


def score_documents(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    sweeps: int = SWEEPS,
    first_kept: int = FIRST_KEPT,
    seed: int = 5,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row, learned from the rows where ``train`` holds.

    * null and empty texts are their end sign alone; a null ``train`` trains;
    * null doc_id: keeps its row; repeated rows each get their row and count each time;
    * no training rows: every word is unknown; no rows: no rows; other columns are ignored.

    ``docs`` must give the same rows in the same order when read again, as a scan does; ``train``
    is a condition on ``doc_id``.
    """
    spark = docs.sparkSession
    rows = named(docs, doc_id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(train, F.lit(True)).alias("train"), "text"
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    layout = find_layout(rows, size, max(12, math.ceil(size / part_bytes)))
    with WorkTables(spark) as work:
        model = fit(work, rows, layout, seed, sweeps, first_kept)
        try:
            run = _score_part(spark.sparkContext.broadcast(model.state), first_kept)
            parts = model.over_parts(run, model.kept(first_kept), "base long, part int, d binary, s binary, b binary, k binary, n binary", "lm-parts")
        finally:
            model.drop()
        while len(work.paths) > 1:
            # The sweeps and totals; the sums of the parts were written last.
            work.drop()
        sums = parts.repartition(layout.parts, "base").groupBy("base").applyInArrow(_unpacked, "_row long, score double, base_score double, n_known long, n_tokens long")
        sums = written(sums, "lm-sums")
    info = rows.select("row", "doc_id", (~F.col("train")).alias("held_out"))
    return info.join(sums, info["row"] == sums["_row"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.state.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """``held_out, perplexity, base_perplexity`` per token."""

    def of(score: str) -> Column:
        return F.pow(F.lit(10.0), -F.sum(score) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))
