"""Cutting Arrow batches into parts of bounded bytes inside a task."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Bytes of text that are worked on at a time, unless a single row has more.
STEP_BYTES = 1 << 20


def _ends(column: pa.Array) -> np.ndarray:
    """Where rows of a string column, or of lists of strings, start and end in its bytes."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return _ends(column.values)[np.asarray(column.offsets)]
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, kind)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def small_steps(column: pa.Array) -> Iterator[pa.Array]:
    """Cut between rows so that the text of one part holds about ``STEP_BYTES``, without copying.

    Some ten bytes of arrays or objects go with each byte of text, so whole batches of long texts would cost gigabytes.
    """
    at = _ends(column).astype(np.int64)
    part = (at[1:] - at[0]) // STEP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        yield column.slice(a, b - a)


def in_steps(column: pa.Array, change: Callable[[list], list], kind: pa.DataType) -> pa.Array:
    """A list function of the rows, a part at a time, as one array."""
    return pa.concat_arrays([pa.array(change(part.to_pylist()), kind) for part in small_steps(column)])


# Travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
