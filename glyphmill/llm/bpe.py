"""Byte-level BPE with a given vocabulary: encoding in two tiers, and decoding.

A text is cut into pre-tokens by the vocabulary's pattern.  The first tier is a minimal perfect
hash over the vocabulary: the distinct pre-tokens of a chunk are looked up together, each at the
one place where it could stand, and compared there byte for byte; those in the vocabulary are
one id.  The second tier takes the misses: neighbouring pairs of linked bytes wait in a heap,
lowest rank first, then leftmost, and merge until no pair has a rank.

Texts are independent of each other, so nothing is shuffled; the vocabulary is broadcast and its
size is the number of its ranks.  A long text is cut and digested in chunks of its pre-tokens.

Rows: null and empty texts give no ids; repeated rows are encoded each; bytes that are no UTF-8
count as the replacement character; other columns pass through, and a column that has the name
of a new one is replaced; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from glyphmill.llm.common import mixed64

# Letters and digits that Unicode 16 added, as ranges of code points.
NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 "
    "113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
)
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"

# Pre-tokens that are laid out together, and misses that a task remembers per generation.
CHUNK = 1 << 18
# Rows of a batch that are unpacked together.
ROWS = 512
MEMO, MEMO_LENGTH = 1 << 17, 64


@dataclass
class PerfectHash:
    """Places 0 to n-1 for n keys, by hash and displacement: one number per bucket moves its keys to free places.

    A bucket of one key may hold its place itself, as a negative number.
    """

    seed: int
    displacement: np.ndarray
    size: int

    def places(self, hashed: np.ndarray) -> np.ndarray:
        moved = self.displacement[(mixed64(hashed) % np.uint64(len(self.displacement))).astype(np.int64)]
        at = _moved(hashed, moved, self.size)
        return np.where(moved < 0, -moved - 1, at)


def _moved(hashed: np.ndarray, by: np.ndarray, size: int) -> np.ndarray:
    return (mixed64(hashed ^ mixed64(by.astype(np.uint64) + np.uint64(1))) % np.uint64(size)).astype(np.int64)


def hashes(keys: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k, seed) for k in keys), np.uint64, len(keys))


def perfect_hash(keys: list[bytes]) -> PerfectHash:
    """Large buckets choose first; single keys take what is left."""
    for seed in range(64):
        hashed = hashes(keys, seed)
        if len(np.unique(hashed)) == len(keys):
            found = _displaced(hashed, seed)
            if found is not None:
                return found
    raise ValueError("the keys are not distinct")


def _displaced(hashed: np.ndarray, seed: int) -> PerfectHash | None:
    n = len(hashed)
    buckets = max(1, n // 3)
    bucket = (mixed64(hashed) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    displacement, taken = np.zeros(buckets, np.int64), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        own = hashed[order[starts[b] : starts[b] + sizes[b]]]
        if len(own) < 2:
            break
        step, tries = 0, 32
        while True:
            at = _moved(own[None, :], np.arange(step, step + tries)[:, None], n)
            ordered = np.sort(at, axis=1)
            fits = ~taken[at].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            good = np.flatnonzero(fits)
            if len(good):
                displacement[b] = step + good[0]
                taken[at[good[0]]] = True
                break
            step, tries = step + tries, min(4 * tries, 1 << 14)
            if step > 1 << 24:
                return None
    single = np.flatnonzero(sizes == 1)
    displacement[single] = -np.flatnonzero(~taken)[: len(single)] - 1
    return PerfectHash(seed, displacement, n)


@dataclass
class Vocabulary:
    """Token bytes by id, the pattern of pre-tokens, and what the two tiers need."""

    tokens: list[bytes]
    pattern: str
    table: PerfectHash = field(init=False)
    by_place: np.ndarray = field(init=False)
    odd: str = field(init=False)
    exact: str = field(init=False)

    def __post_init__(self):
        missing = {bytes([b]) for b in range(256)} - set(self.tokens)
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.table = perfect_hash(self.tokens)
        places = self.table.places(hashes(self.tokens, self.table.seed))
        self.by_place = np.empty(len(self.tokens), np.int64)
        self.by_place[places] = np.arange(len(self.tokens))
        self.odd, self.exact = _exact_pattern(self.pattern)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of lines with a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[k] for k in range(len(ranks))]


def _ranges(points: set[int]) -> str:
    """Code points as the inside of a character class."""
    ordered = np.array(sorted(points))
    cuts = np.flatnonzero(np.diff(ordered) > 1) + 1
    return "".join(f"\\U{int(run[0]):08x}-\\U{int(run[-1]):08x}" for run in np.split(ordered, cuts) if len(run))


def _exact_pattern(pattern: str) -> tuple[str, str]:
    """The points on which the matcher's newer tables differ from Unicode 16, and the pattern with that version's classes spelled out."""
    every = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    joined = "".join(every)
    odd, classes = set(), {}
    for letter, added in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
        own = {ord(c) for c in every if unicodedata.category(c)[0] == letter}
        for a, b in (r.split("-") for r in added.split()):
            own.update(range(int(a, 16), int(b, 16) + 1))
        odd |= own ^ set(map(ord, regex.findall(rf"\p{{{letter}}}", joined)))
        classes[rf"\p{{{letter}}}"] = _ranges(own)

    def spelled(match: re.Match) -> str:
        out = match[0]
        for name, inside in classes.items():
            out = out.replace(name, inside if out[0] == "[" else f"[{inside}]")
        return out

    return _ranges(odd), re.sub(r"\[[^\]]*\]|\\p\{[LN]\}", spelled, pattern)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank merges first, the leftmost among equals.

    ``after[i]`` is where the symbol that starts at byte i ends and the next one starts; -1 marks
    bytes inside a symbol.  A heap entry is a rank, a start and a length in one number; it is
    stale when the pair that starts there has another length by now.
    """
    n = len(piece)
    get = ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = []
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            heap.append(rank << 64 | i << 32 | 2)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        i, length = entry >> 32 & 0xFFFFFFFF, entry & 0xFFFFFFFF
        j = after[i]
        if j < 0 or j >= n or after[j] - i != length:
            continue
        end = after[j]
        after[i], after[j], before[end] = end, -1, i
        if i:
            left = before[i]
            rank = get(piece[left:end])
            if rank is not None:
                push(heap, rank << 64 | left << 32 | end - left)
        if end < n:
            right = after[end]
            rank = get(piece[i:right])
            if rank is not None:
                push(heap, rank << 64 | i << 32 | right - i)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """The vocabulary as one task uses it."""

    def __init__(self, vocabulary: Vocabulary):
        self.table, self.by_place = vocabulary.table, vocabulary.by_place
        self.tokens = pa.array(vocabulary.tokens, pa.large_binary())
        self.ranks = {t: k for k, t in enumerate(vocabulary.tokens)}
        self.fast, self.exact = regex.compile(vocabulary.pattern), regex.compile(vocabulary.exact)
        self.odd = re.compile(f"[{vocabulary.odd}]") if vocabulary.odd else None
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in lists of at most ``CHUNK``."""
        plain = text.isascii() or self.odd is None or not self.odd.search(text)
        pattern = self.fast if plain else self.exact
        if len(text) <= CHUNK:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while chunk := list(islice(found, CHUNK)):
            yield chunk

    def ids(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens in a row, and how many each has."""
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary())
        keys = distinct.to_pylist()
        # First tier: the token at a key's place is the key, or the key is not in the vocabulary.
        there = self.by_place[self.table.places(hashes(keys, self.table.seed))]
        hit = np.asarray(pc.equal(self.tokens.take(pa.array(there)), distinct))
        missed = np.flatnonzero(~hit)
        memo, older, found = self.memo, self.older, []
        for k in missed.tolist():
            key = keys[k]
            own = memo.get(key)
            if own is None:
                own = older.get(key)
                if own is None:
                    own = array("I", merged(key, self.ranks)).tobytes()
                if len(key) <= MEMO_LENGTH:
                    memo[key] = own
            found.append(own)
        if len(memo) > MEMO:
            self.older, self.memo = memo, {}
        sizes = np.ones(len(keys), np.int64)
        sizes[missed] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # Ids of the hits, then those of the misses.
        pool = np.concatenate([there[hit].astype("<u4"), np.frombuffer(b"".join(found), "<u4")])
        starts = np.empty(len(keys), np.int64)
        order = np.concatenate([np.flatnonzero(hit), missed])
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        index = np.asarray(coded.indices, dtype=np.int64)
        each = sizes[index]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        return pool[np.repeat(starts[index] - (ends - each), each) + np.arange(total)], each

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers; short texts go through together."""
        flat: list[str] = []
        counts: list[int] = []
        for text in map(_decoded, texts):
            if len(text) > CHUNK or len(flat) > CHUNK:
                yield from self._together(flat, counts)
                flat, counts = [], []
            if len(text) > CHUNK:
                yield b"".join(self.ids(chunk)[0].tobytes() for chunk in self.pieces(text))
                continue
            own = next(self.pieces(text))
            flat += own
            counts.append(len(own))
        yield from self._together(flat, counts)

    def _together(self, flat: list[str], counts: list[int]) -> Iterator[bytes]:
        ids, each = self.ids(flat)
        ends = np.concatenate(([0], np.cumsum(each)))[np.cumsum(counts, dtype=np.int64)]
        for a, b in zip(np.concatenate(([0], ends)), ends):
            yield ids[a:b].tobytes()


def _decoded(text: bytes) -> str:
    return text.decode("utf-8", "replace")


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    """The values of a column a few at a time, so that a batch is never held twice."""
    for at in range(0, len(column), ROWS):
        yield [b"" if x is None else x for x in column.slice(at, ROWS).cast(pa.large_binary()).to_pylist()]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text, as little-endian unsigned 32-bit integers in one binary value."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for column in batches:
            yield pa.array((ids for texts in _texts(column) for ids in encoder.encode(texts)), pa.binary())

    return docs.withColumn(out_col, encoded(F.col(f"`{text_col}`")))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that the ids stand for; null ids are none, ids outside the vocabulary an error."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pa.array(shared.value.tokens, pa.large_binary())
        for column in batches:
            yield pa.array((b"".join(decoded_chunks(x, tokens)) for ids in _texts(column) for x in ids), pa.binary())

    return rows.withColumn(out_col, decoded(F.col(f"`{ids_col}`")))


def decoded_chunks(ids: bytes, tokens: pa.Array) -> Iterator[bytes]:
    """The bytes behind packed ids, ``CHUNK`` ids at a time."""
    every = np.frombuffer(ids, "<u4")
    for at in range(0, len(every), CHUNK):
        taken = tokens.take(pa.array(every[at : at + CHUNK]))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        yield taken.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()


DIGESTS = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")


def digests(rows: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: each text encoded and its ids decoded again, in one pass over the texts."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(DIGESTS)
    def digested(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for column in batches:
            out = []
            for texts in _texts(column):
                for ids in encoder.encode(texts):
                    back = hashlib.sha256()
                    for chunk in decoded_chunks(ids, encoder.tokens):
                        back.update(chunk)
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()))
            n, coded, decoded = zip(*out) if out else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], DIGESTS.names)

    found = rows.select(F.col(f"`{id_col}`").alias("doc_id"), digested(F.col(f"`{text_col}`")).alias("digests"))
    return found.select("doc_id", "digests.*")
