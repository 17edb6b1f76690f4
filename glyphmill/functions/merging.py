"""Encoding a batch of pieces inside a task.

Spark cuts text into pieces and moves the batches; this helper only turns each distinct piece
of a batch into ids, lowest ranked pair first, and lays the ids out as Arrow lists.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle

MEMO_PIECES = 200_000
MEMO_LENGTH = 64


def merge_symbols(symbols: list, find) -> list:
    """Merge neighbours while ``find(pair)`` knows one: lowest (rank, position) first.

    ``find`` gives ``(rank, merged)`` or None.
    """
    heap = []
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        found = find(pair)
        if found is not None:
            heap.append((found[0], i, pair, found[1]))
    if not heap:
        return symbols
    heapq.heapify(heap)
    size = len(symbols)
    before, after = list(range(-1, size)), list(range(1, size + 1))
    while heap:
        _, i, pair, merged = heapq.heappop(heap)
        j = after[i]
        if j >= size or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue  # one side has been merged away since
        symbols[i], symbols[j] = merged, None
        after[i], before[after[j]] = after[j], i
        for left in (before[i], i):
            if left >= 0 and after[left] < size:
                pair = (symbols[left], symbols[after[left]])
                found = find(pair)
                if found is not None:
                    heapq.heappush(heap, (found[0], left, pair, found[1]))
    return [s for s in symbols if s is not None]


def piece_ids(piece: str, tables: dict) -> list[int]:
    known = tables["fixed"].get(piece)
    if known is not None:
        return [known]
    if tables["symbols"] == "bytes":
        ids = [i for i in map(tables["byte_ids"].__getitem__, piece.encode()) if i is not None]
        if len(ids) < 2:
            return ids
        return merge_symbols(ids, tables["ranks"].get)
    scores, ids, byte_ids, unk = tables["scores"], tables["ids"], tables["byte_ids"], tables["unk"]

    def find(pair: tuple):
        text = pair[0] + pair[1]
        score = scores.get(text)
        return None if score is None else (-score, text)

    out = []
    for token in merge_symbols(list(piece), find):
        if token in ids:
            out.append(ids[token])
        else:
            raw = [byte_ids[b] for b in token.encode()]
            out.extend(raw if None not in raw else [unk])
    return out


def batch_ids(pieces: pa.Array, tables: dict) -> pa.Array:
    """list<string> to list<int32>, row by row, encoding each distinct piece once."""
    if len(tables["memo"]) > MEMO_PIECES:
        # Frequent pieces come back from the older half; the rest is forgotten at the next turn.
        tables["older"], tables["memo"] = tables["memo"], {}
    memo, older = tables["memo"], tables["older"]
    lengths = np.asarray(pieces.value_lengths().fill_null(0))
    coded = pieces.flatten().dictionary_encode()
    distinct = []
    for piece in coded.dictionary.to_pylist():
        ids = memo.get(piece)
        if ids is None:
            ids = older.get(piece)
            if ids is None:
                ids = piece_ids(piece, tables)
            if len(piece) <= MEMO_LENGTH:
                memo[piece] = ids
        distinct.append(ids)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    pool = np.fromiter((i for ids in distinct for i in ids), np.int32, int(sizes.sum()))
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(sizes) else np.zeros(0, np.int64)
    index = np.asarray(coded.indices, dtype=np.int64)
    per_piece = sizes[index]
    ends = np.cumsum(per_piece)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(starts[index] - (ends - per_piece), per_piece) + np.arange(total)
    ends = np.concatenate(([0], ends))
    offsets = ends[np.concatenate(([0], np.cumsum(lengths)))].astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(pool[source], pa.int32()))
    if pieces.null_count:
        out = pa.compute.if_else(pieces.is_valid(), out, pa.scalar(None, out.type))
    return out


# Travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
