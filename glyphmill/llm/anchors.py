"""Content-defined anchors in texts, and hashes of stretches of bytes.

A window of ``WINDOW`` bytes chooses the position in it whose ``GRAM`` bytes hash lowest, the
leftmost of several.  Equal windows choose the same position, wherever they stand, so all equal
windows meet at their anchors.  Neighbouring windows mostly share their anchor: there are about
two anchors in ``WINDOW - GRAM`` bytes of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from glyphmill.llm.common import mixed64

WINDOW, GRAM = 200, 24
_REACH = WINDOW - GRAM + 1
# Longer texts are cut into pieces that overlap by a window less one byte.
PIECE = 1 << 20
_POSITION = 24

# fixed values: an odd base and its inverse modulo 2^64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mixed64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashed:
    """Prefix hashes of a buffer; the hash of any stretch of it takes one step."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        with np.errstate(over="ignore"):
            self._sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.add.accumulate(_BYTE[buffer] * _powers(_BASE, max(1, n))[:n])))
        self._back = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed64((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(np.uint64))

    def grams(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed64((self._sums[GRAM:] - self._sums[:-GRAM]) * self._back[: len(self._sums) - GRAM])


def lowest(keys: np.ndarray, reach: int) -> np.ndarray:
    """The least of each ``reach`` neighbouring keys, from running minima of blocks of that length."""
    n = len(keys) - reach + 1
    padded = np.full(-(-len(keys) // reach) * reach, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n])


@dataclass
class Runs:
    """Neighbouring windows with one anchor: the anchor's gram, the first window's start, the number
    of windows, the anchor's distance from the first start, and the hash of all bytes they cover."""

    gram: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    lead: np.ndarray
    whole: np.ndarray
    text: np.ndarray


def anchor_runs(texts: list[bytes]) -> Runs:
    """Of all windows of several texts; starts count from each text's beginning."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.empty(0, dtype=np.int64)
    if len(buffer) < WINDOW:
        return Runs(none.view(np.uint64), none, none, none, none.view(np.uint64), none)
    hashed = Hashed(buffer)
    grams = hashed.grams()
    positions = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << _POSITION) - 1)
    best = (lowest(grams & ~low | positions, _REACH) & low).astype(np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    own = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - WINDOW + 1))
    counts = np.maximum(0, sizes - WINDOW + 1)
    starts = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[own]
    anchor = best[starts]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])))) if len(own) else none
    n = np.diff(np.append(new, len(own)))
    first, text = starts[new], own[new]
    return Runs(grams[anchor[new]], first - begins[text], n, anchor[new] - first, hashed.of(first, first + n + WINDOW - 1), text)
