"""Whitened principal components of embeddings.

Entries are put on an integer grid, so counts and sums are exact.  The model is fitted on each
distinct grid vector once:

* Every task keeps the spectrum of what it has seen: count, mean, eigenvalues and eigenvectors of
  the scatter.  A block of rows is reduced by orthogonal rotations to as many rows as there are
  dimensions, which changes neither its sum of squares nor its mean; each of these is one centred
  rank-one update of the spectrum: the secular equation gives the new eigenvalues, after
  deflation of components that the row does not move.
* Spectra of tasks are combined a few at a time, the eigenvectors of one being successive rank-one
  updates of the other, and the difference of their means a further one.
* The combined basis is refined by Rayleigh and Ritz: the centred rows are projected on it, their
  small covariance summed over all tasks, and its eigenvectors turn the basis.

What tasks return and the driver holds is one square matrix of the dimensions.

Rows: vectors that are null, empty or hold null or non-finite entries are dropped, as are those
whose length is not the most frequent one (of equals the longer); entries beyond ``2**40`` count as
that; null and repeated ids keep their rows; a component without variance beyond rounding is
left out, so one distinct vector gives no rows; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphmill.llm.common import named
from glyphmill.session import written

SCALE, SHIFT, LIMIT = 64, 1_000_000, float(1 << 40)
COMPONENTS = 16
# Rows whose rotation is one block of updates, and spectra that one task combines.
BLOCK_ROWS, FAN_IN = 1024, 8
_EPS = np.finfo(np.float64).eps


def on_grid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the usable rows with their grid vectors."""
    rows = named(vectors, vec_id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<double>"))
    plain = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.coalesce(plain & (F.size("vector") > 0), F.lit(False)))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = lengths[0].length if lengths else 0

    def grid(c):
        return F.floor(F.greatest(F.least(c, F.lit(LIMIT)), F.lit(-LIMIT)) * SCALE) + SHIFT

    return rows.where(F.size("vector") == length).select("vec_id", F.transform("vector", grid).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


@dataclass
class Spectrum:
    """Eigenvalues (rising) and eigenvectors (columns) of the scatter of ``n`` rows around their mean."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def _scatter(self, row: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, row)

    def _moved(self, n: int, mean: np.ndarray) -> None:
        """``n`` more rows around ``mean``: what the distance of the means adds to the scatter."""
        total = self.n + n
        if self.n:
            self._scatter((mean - self.mean) * np.sqrt(self.n * (n / total)))
        self.mean = self.mean + (mean - self.mean) * (n / total)
        self.n = total

    def add(self, rows: np.ndarray) -> None:
        """A block of rows, one centred rank-one update for each row of its triangular factor."""
        mean = rows.mean(axis=0)
        centred = rows - mean
        for row in np.linalg.qr(centred, mode="r") if len(rows) > rows.shape[1] else centred:
            self._scatter(row)
        self._moved(len(rows), mean)

    def combine(self, other: Spectrum) -> None:
        for k in np.flatnonzero(other.values > 0):
            self._scatter(other.vectors[:, k] * np.sqrt(other.values[k]))
        self._moved(other.n, other.mean)

    def packed(self) -> dict:
        return {"n": self.n, "mean": self.mean.tobytes(), "eigenvalues": self.values.tobytes(), "eigenvectors": np.ascontiguousarray(self.vectors).tobytes()}

    @classmethod
    def unpacked(cls, row: dict) -> Spectrum:
        mean, values = np.frombuffer(row["mean"]), np.frombuffer(row["eigenvalues"])
        return cls(row["n"], mean, values, np.frombuffer(row["eigenvectors"]).reshape(len(mean), -1))


def rank_one(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``vectors @ diag(values) @ vectors.T + row row.T``; ``values`` rise."""
    z = vectors.T @ row
    weight = float(z @ z)
    if weight == 0:
        return values, vectors
    size = max(abs(values[-1]), weight)
    # Deflation: a component that the row hardly meets keeps its pair.
    tol = 8 * _EPS * size
    moves = np.abs(z) * np.sqrt(weight) > tol
    # Of components with one eigenvalue, a rotation leaves a single one that meets the row.
    live = np.flatnonzero(moves)
    near = np.flatnonzero(np.diff(values[live]) <= tol) if len(live) > 1 else ()
    if len(near):
        vectors, z = vectors.copy(), z.copy()
        for k in near:
            a, b = live[k], live[k + 1]
            length = np.hypot(z[a], z[b])
            c, s = z[b] / length, z[a] / length
            left, right = vectors[:, a].copy(), vectors[:, b].copy()
            vectors[:, a], vectors[:, b] = c * left - s * right, s * left + c * right
            z[a], z[b] = 0.0, length
        moves[live[near]] = False
        live = np.flatnonzero(moves)
    if not len(live):
        return values, vectors
    own, z = values[live], z[live]
    base, step = secular_roots(own, z)
    # Differences of each new eigenvalue to each old one, without cancellation.
    gaps = (own[base][:, None] - own[None, :]) + step[:, None]
    # The row for which these roots are exact, so that the new eigenvectors are orthogonal.
    between = own[:, None] - own[None, :]
    np.fill_diagonal(between, 1.0)
    exact = np.copysign(np.sqrt(np.abs((gaps / between).prod(axis=0))), z)
    turned = exact[None, :] / gaps
    turned /= np.sqrt((turned * turned).sum(axis=1))[:, None]
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[live] = own[base] + step
    new_vectors[:, live] = vectors[:, live] @ turned.T
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


def secular_roots(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z**2 / (poles - x))``, one above each pole: the nearer pole's index and the distance to it.

    The poles rise strictly.  Each root is bracketed between its pole and the next, measured from the
    nearer of the two; steps interpolate the sums over the poles on either side and fall back to
    halving.
    """
    k = len(poles)
    square = z * z
    upper = np.append(poles[1:], poles[-1] + square.sum())
    width = upper - poles
    # The sign in the middle says which end is nearer; the last root is measured from its own pole.
    middle = poles + width / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        f = 1 + (square[None, :] / ((poles[None, :] - poles[:, None]) - (width / 2)[:, None])).sum(axis=1)
        right = (f < 0) & (np.arange(k) < k - 1)
        base = np.arange(k) + right
        shifted = poles[None, :] - poles[base][:, None]
        low = np.where(right, -width / 2, np.where(f < 0, width / 2, 0.0))
        high = np.where(right, 0.0, np.where(f < 0, width, width / 2))
        x = (low + high) / 2
        below = np.arange(k)[None, :] <= np.arange(k)[:, None]
        for _ in range(80):
            d = shifted - x[:, None]
            terms = square[None, :] / d
            psi, phi = np.where(below, terms, 0.0), np.where(below, 0.0, terms)
            slope = terms / d
            s_psi, s_phi = np.where(below, slope, 0.0).sum(axis=1), np.where(below, 0.0, slope).sum(axis=1)
            f = 1 + psi.sum(axis=1) + phi.sum(axis=1)
            done = np.abs(f) <= 4 * _EPS * k * (1 + np.abs(psi.sum(axis=1)) + np.abs(phi.sum(axis=1)))
            low, high = np.where(f < 0, x, low), np.where(f >= 0, x, high)
            narrow = (high - low) <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
            if (done | narrow).all():
                break
            # Fit a pole at each end of the bracket to value and slope of the two sums.
            a = np.take_along_axis(d, np.arange(k)[:, None], axis=1)[:, 0]
            b = np.take_along_axis(d, np.minimum(np.arange(k) + 1, k - 1)[:, None], axis=1)[:, 0]
            b = np.where(np.arange(k) < k - 1, b, np.inf)
            c = 1 + (psi.sum(axis=1) - s_psi * a) + np.where(np.isfinite(b), phi.sum(axis=1) - s_phi * b, 0.0)
            p, q = s_psi * a * a, np.where(np.isfinite(b), s_phi * b * b, 0.0)
            # c + p / (a - t) + q / (b - t) = 0 for a step t.
            lin = np.where(np.isfinite(b), c * (a + b) + p + q, c * a + p)
            const = np.where(np.isfinite(b), c * a * b + p * b + q * a, 0.0)
            root = np.sqrt(np.maximum(lin * lin - 4 * c * const, 0.0))
            step = np.where(np.isfinite(b), np.where(lin > 0, 2 * const / (lin + root), (lin - root) / (2 * c)), lin / c)
            t = x + step
            inside = np.isfinite(t) & (t > low) & (t < high)
            x = np.where(done | narrow, x, np.where(inside, t, (low + high) / 2))
    return base, x


_PACKED = "n long, mean binary, eigenvalues binary, eigenvectors binary"


_KINDS = pa.schema({"n": pa.int64(), "mean": pa.binary(), "eigenvalues": pa.binary(), "eigenvectors": pa.binary()})


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spectrum of a task's grid vectors."""
    spectrum = None
    for batch in batches:
        x = _matrix(batch.column(0)).astype(np.float64)
        for at in range(0, len(x), BLOCK_ROWS):
            spectrum = spectrum or Spectrum.empty(x.shape[1])
            spectrum.add(x[at : at + BLOCK_ROWS])
    if spectrum is not None:
        yield pa.RecordBatch.from_pylist([spectrum.packed()], _KINDS)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All spectra of a task as one."""
    whole = None
    for batch in batches:
        for row in batch.to_pylist():
            other = Spectrum.unpacked(row)
            if whole is None:
                whole = other
            else:
                whole.combine(other)
    if whole is not None:
        yield pa.RecordBatch.from_pylist([whole.packed()], _KINDS)


def spectrum(fit_list: DataFrame) -> Spectrum | None:
    """The spectrum of all rows of ``x``; each round combines up to ``FAN_IN`` spectra in a task."""
    found = written(fit_list.select("x").mapInArrow(_spectra, _PACKED), "spectra")
    n = found.count()
    while n > 1:
        n = -(-n // FAN_IN)
        found = written(found.repartition(n).mapInArrow(_combined, _PACKED), "spectra")
    rows = found.collect()
    return Spectrum.unpacked(rows[0].asDict()) if rows else None


@dataclass
class Whitening:
    """Exact count and sums of the fit list, and its leading components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S/n``: the whole part of the mean is taken off while entries are integers."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n*x - S)**2``, exact; null where it is beyond 64 bits."""
        if not len(x):
            return []
        far = self.n * int(np.abs(x).max()) + max(abs(s) for s in self.sums)
        if far < 1 << 62:
            apart = self.n * x - np.array(self.sums, dtype=np.int64)
            if len(self.sums) * int(np.abs(apart).max()) ** 2 < 1 << 62:
                return (apart * apart).sum(axis=1).tolist()
        exact = (sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x)
        return [v if v < 1 << 63 else None for v in exact]


_SUMS = "k int, value double, whole long"


def _sums_of(values: np.ndarray, whole: np.ndarray | None = None) -> pa.RecordBatch:
    values = np.asarray(values, dtype=np.float64).ravel()
    whole = np.zeros(len(values), np.int64) if whole is None else whole
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values), pa.array(whole, pa.int64())], ["k", "value", "whole"])


def _summed(rows: DataFrame, function) -> list:
    """Per position the sums over all tasks; positions are at most the square of the dimensions."""
    parts = rows.mapInArrow(function, _SUMS)
    found = parts.groupBy("k").agg(F.sum("value").alias("value"), F.sum(F.col("whole").cast("decimal(38,0)")).alias("whole"))
    return sorted((r.k, r.value, int(r.whole)) for r in found.collect())


def _whole_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(0))
        for at in range(0, len(x), 1 << 14):  # sums of so many entries fit 64 bits
            own = x[at : at + (1 << 14)]
            yield _sums_of(np.zeros(x.shape[1] + 1), np.append(len(own), own.sum(axis=0)))


def _products(shared, project):
    """Sums of products of projected rows, and of the projected rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                y = project(shared.value, x)
                own = np.vstack([y.T @ y, y.sum(axis=0)])
                total = own if total is None else total + own
        if total is not None:
            yield _sums_of(total)

    return run


def fit(fit_list: DataFrame) -> Whitening | None:
    """Components of the distinct vectors ``x`` by falling eigenvalue."""
    sums = _summed(fit_list.select("x"), _whole_sums)
    if not sums:
        return None
    n, whole = sums[0][2], [s for _, _, s in sums[1:]]
    start = spectrum(fit_list)
    # Rounding of many updates leaves the basis nearly orthogonal; the refinement needs it exactly so.
    basis, _ = np.linalg.qr(start.vectors[:, ::-1])
    d = len(whole)
    model = Whitening(n, whole, np.ones(d), basis, 0.0)
    shared = fit_list.sparkSession.sparkContext.broadcast(model)
    found = np.array([v for _, v, _ in _summed(fit_list.select("x"), _products(shared, lambda m, x: m.centred(x) @ m.vectors))]).reshape(d + 1, d)
    mean = found[d] / n
    small = found[:d] / n - np.outer(mean, mean)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1], basis @ turned[:, ::-1]
    return Whitening(n, whole, values, vectors, float(values.sum()))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per usable row and leading component."""
    spark = vectors.sparkSession
    rows = on_grid(vectors, id_col, vector_col)
    fit_list = written(rows.select("x").distinct(), "grid")
    model = fit(fit_list)
    kept = 0
    if model is not None:
        kept = int(np.count_nonzero(model.values[:components] > _EPS * len(model.values) * max(model.values[0], 0.0)))
        explained = model.values[:kept] / model.trace if kept else np.zeros(0)
        model = Whitening(model.n, model.sums, model.values[:kept], model.vectors[:, :kept], model.trace)
    error = 0.0
    if kept:
        shared = spark.sparkContext.broadcast(model)
        found = np.array([v for _, v, _ in _summed(fit_list.select("x"), _products(shared, lambda m, x: m.whitened(x)))]).reshape(kept + 1, kept)
        mean = found[kept] / model.n
        error = float(np.abs(found[:kept] / model.n - np.outer(mean, mean) - np.eye(kept)).max())

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not kept or not len(x):
                continue
            own = shared.value
            white = own.whitened(x)
            m = len(x)
            row = pa.array(np.repeat(np.arange(m), kept))
            columns = [
                batch.column("vec_id").take(row),
                pa.array(np.tile(np.arange(1, kept + 1), m), pa.int32()),
                pa.array(np.full(m * kept, own.n), pa.int64()),
                pa.array(own.deviation(x), pa.int64()).take(row),
                pa.array(white.ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * kept, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(projected, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
