"""Many words in one row: their symbols end to end, and how often each word occurs.

Spark deals the rows out, keeps them between rounds and sums what tasks return; this helper only
looks for pairs of neighbours in one row's arrays at a time.  Symbols are ids, a gap between two
words is ``GAP``, and a pair is one number that orders like its two ids.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

GAP = np.int32(-1)
# Symbols that one row gathers at most, unless a single word has more.
ROW_SYMBOLS = 1 << 20
PACKED = "syms binary, counts binary"
# Code points of symbol strings, see ``symbols.code_char``.
_FIRST, _SURROGATES, _SKIPPED = 0x100, 0xD800, 0x800


def pair_code(left: int, right: int) -> int:
    return left << 32 | right


@dataclass(frozen=True)
class Step:
    """Merges that no other one of the step can touch: sorted pair numbers and the symbols they become."""

    pairs: np.ndarray
    made: np.ndarray

    @classmethod
    def of(cls, merges: Sequence[tuple[int, int, int]]) -> Step:
        rows = sorted((pair_code(a, b), c) for a, b, c in merges)
        return cls(np.array([p for p, _ in rows], np.int64), np.array([c for _, c in rows], np.int32))


def packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (syms string, n) as packed rows."""
    words: list[str] = []
    counts: list[int] = []
    size = 0
    for batch in batches:
        for word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if size and size + len(word) > ROW_SYMBOLS:
                yield _row(*_from_strings(words, counts))
                words, counts, size = [], [], 0
            words.append(word)
            counts.append(n)
            size += len(word) + 1
    if words:
        yield _row(*_from_strings(words, counts))


def _from_strings(words: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), "<u4").astype(np.int32)
    ids = points - _FIRST - np.where(points >= _SURROGATES + _SKIPPED, _SKIPPED, 0).astype(np.int32)
    return np.where(points == 0, GAP, ids), np.array(counts, np.int64)


def _row(syms: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([syms.astype("<i4").tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["syms", "counts"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        # Views of the batch, which may hold many rows; nothing is copied.
        for syms, counts in zip(*batch.columns):
            yield np.frombuffer(syms.as_buffer(), "<i4"), np.frombuffer(counts.as_buffer(), "<i8")


def _places(syms: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of the sorted pair numbers starts, and which one."""
    top = int(max(syms.max(initial=0), (pairs >> 32).max(), (pairs & 0xFFFFFFFF).max())) + 2
    left, right = np.zeros(top, bool), np.zeros(top, bool)
    left[pairs >> 32] = True
    right[pairs & 0xFFFFFFFF] = True
    # A gap is -1, the last place of the table, which no pair marks.
    at = np.flatnonzero(left[syms[:-1]] & right[syms[1:]])
    codes = syms[at].astype(np.int64) << 32 | syms[at + 1]
    which = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
    hit = pairs[which] == codes
    return at[hit], which[hit]


def _found(syms: np.ndarray, step: Step) -> tuple[np.ndarray, np.ndarray]:
    """Where a pair of the step starts, and which one; of overlapping ones the left."""
    at, which = _places(syms, step.pairs)
    # Only a pair of one symbol with itself can overlap: of a run of starts every other one counts.
    begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    if len(begins) < len(at):
        first = np.repeat(at[begins], np.diff(np.append(begins, len(at))))
        even = (at - first) % 2 == 0
        at, which = at[even], which[even]
    return at, which


def merged(syms: np.ndarray, step: Step) -> np.ndarray:
    at, which = _found(syms, step)
    if not len(at):
        return syms
    out = syms.copy()
    out[at] = step.made[which]
    return np.delete(out, at + 1)


def _pairs(syms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all neighbours inside words, and the counts of their words."""
    word = np.cumsum(syms == GAP)
    inside = np.flatnonzero((syms[:-1] != GAP) & (syms[1:] != GAP))
    return syms[inside].astype(np.int64) << 32 | syms[inside + 1], counts[word[inside]]


def _summed(pairs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[starts], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0]


def pair_sums(pending: Sequence[Step]):
    """(pair, n) of every pair, after the pending merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for syms, counts in _rows(batches):
            for step in pending:
                syms = merged(syms, step)
            pairs, n = _summed(*_pairs(syms, counts))
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    return run


def _before(pending: Sequence[Step], step: Step) -> np.ndarray:
    """Pairs that stand where a pair of the step will, before the pending merges: the end of its left and the start of its right symbol."""
    starts: dict[int, set[int]] = {}
    ends: dict[int, set[int]] = {}
    for earlier in pending:
        for pair, made in zip(earlier.pairs.tolist(), earlier.made.tolist()):
            # A symbol may be made in more than one way, and stand in the rows already.
            a, b = pair >> 32, pair & 0xFFFFFFFF
            starts[made] = {made} | starts.get(made, set()) | starts.get(a, {a})
            ends[made] = {made} | ends.get(made, set()) | ends.get(b, {b})
    sides = ((p >> 32, p & 0xFFFFFFFF) for p in step.pairs.tolist())
    return np.array(sorted({pair_code(x, y) for a, b in sides for x in ends.get(a, {a}) for y in starts.get(b, {b})}), np.int64)


def _holding(syms: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that hold one of the places, and their counts."""
    gaps = np.flatnonzero(syms == GAP)
    touched = np.zeros(len(counts), bool)
    touched[np.searchsorted(gaps, at)] = True
    return syms[np.repeat(touched, np.diff(gaps, prepend=-1))], counts[touched]


def pair_changes(pending: Sequence[Step], step: Step, held: np.ndarray):
    """(pair, n, known): net changes by a step after the pending ones, of held pairs and of pairs with a new symbol.

    Only words that may come to hold a pair of the step go through the pending merges, and of these only those that do are counted.
    ``held`` is sorted.
    """
    first_new, sought = int(step.made.min()), _before(pending, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for syms, counts in _rows(batches):
            syms, counts = _holding(syms, counts, _places(syms, sought)[0])
            for before in pending:
                syms = merged(syms, before)
            at, _ = _found(syms, step)
            if not len(at):
                continue
            old, n = _holding(syms, counts, at)
            pairs, gone = _pairs(old, n)
            more, came = _pairs(merged(old, step), n)
            pairs, net = _summed(np.concatenate((pairs, more)), np.concatenate((-gone, came)))
            fresh = (pairs >> 32 >= first_new) | (pairs & 0xFFFFFFFF >= first_new)
            known = np.zeros(len(pairs), bool)
            if len(held):
                known = held[np.minimum(np.searchsorted(held, pairs), len(held) - 1)] == pairs
            kept = (net != 0) & (known | fresh)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[kept]), pa.array(net[kept]), pa.array(known[kept])], ["pair", "n", "known"])

    return run


def rebuilt(pending: Sequence[Step]):
    """Packed rows after the pending merges, without words that have become one symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for syms, counts in _rows(batches):
            for step in pending:
                syms = merged(syms, step)
            ends = np.flatnonzero(syms == GAP)
            lengths = np.diff(ends, prepend=-1)
            long = lengths > 2
            if long.any():
                yield _row(syms[np.repeat(long, lengths)], counts[long])

    return run


# Travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
