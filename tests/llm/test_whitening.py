from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import whitening
from glyphmill.llm.queries import op13_whitening
from glyphmill.llm.whitening import Spectrum, rank_one, secular_roots


def same_matrix(values, vectors, expected, tol=1e-12):
    size = max(1.0, np.abs(expected).max())
    assert np.abs(vectors @ np.diag(values) @ vectors.T - expected).max() <= tol * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12
    assert (np.diff(values) >= 0).all()


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(1)
    for k in (1, 2, 5, 40):
        poles = np.sort(rng.normal(size=k) * 10)
        z = rng.normal(size=k) * 10.0 ** rng.integers(-6, 3, k)
        base, step = secular_roots(poles, z)
        found = poles[base] + step
        expected = np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z))
        assert np.allclose(found, expected, rtol=1e-12, atol=1e-12 * np.abs(expected).max())
        assert (found >= poles).all()


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates_with_ties_zeros_and_tiny_rows(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 24))
    values, vectors, total = np.zeros(d), np.eye(d), np.zeros((d, d))
    for k in range(60):
        row = rng.normal(size=d) * 10.0 ** rng.integers(-8, 4)
        if k % 5 == 0:
            row = np.zeros(d)
            row[rng.integers(d)] = 3.0
        if k % 7 == 0:
            row = np.zeros(d)
        total += np.outer(row, row)
        values, vectors = rank_one(values, vectors, row)
    same_matrix(values, vectors, total)


def test_blocks_rows_and_combinations_agree():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) * 50) + 1_000_000
    centred = x - x.mean(axis=0)
    whole = Spectrum.empty(7)
    whole.add(x)
    single = Spectrum.empty(7)
    for row in x:
        single.add(row[None, :])
    joined = Spectrum.empty(7)
    for part in np.array_split(x, 4):
        own = Spectrum.empty(7)
        own.add(part)
        joined.combine(own)
    for spectrum in (whole, single, joined):
        assert spectrum.n == 300 and np.allclose(spectrum.mean, x.mean(axis=0), rtol=1e-14)
        same_matrix(spectrum.values, spectrum.vectors, centred.T @ centred, 1e-11)


def brute(vectors):
    x = [np.floor(64 * np.array(v)) + 1_000_000 for _, v in vectors]
    fit = np.unique(np.array(x), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = (fit - sums / n).T @ (fit - sums / n) / n
    values, vecs = np.linalg.eigh(cov)
    return x, n, sums, values[::-1], vecs[:, ::-1]


def checked(rows, vectors, components=16):
    x, n, sums, values, vecs = brute(vectors)
    found = defaultdict(list)
    for r in rows:
        found[r.vec_id].append(r)
    assert len(rows) == len(vectors) * min(components, len(values))
    white = np.array([[r.whitened for r in sorted(found[i], key=lambda r: r.component)] for i, _ in vectors])
    for k in range(white.shape[1]):
        own = np.array([v - sums / n for v in x]) @ vecs[:, k] / np.sqrt(values[k])
        assert min(np.abs(own - white[:, k]).max(), np.abs(own + white[:, k]).max()) < 1e-6
    for (i, _), v in zip(vectors, x):
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))
        assert {r.deviation for r in found[i]} == {exact} and {r.n for r in found[i]} == {n}
        for r in found[i]:
            assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8


def test_query_equals_brute_force(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()
    checked(op13_whitening(spark, sf_small).collect(), [(r[0], r[1]) for r in table])


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, x string")


def test_copies_count_once_and_odd_rows_go(spark):
    rng = np.random.default_rng(5)
    base = [rng.normal(size=3).tolist() for _ in range(40)]
    vectors = [(k, base[k % 40]) for k in range(90)]
    odd = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 2.0]), (904, [float("inf"), 0.0, 0.0]), (905, [1.0, 2.0])]
    out = whitening.whiten(frame(spark, [(i, v, "n", "x") for i, v in vectors + odd])).collect()
    assert {r.vec_id for r in out} == set(range(90))
    checked(out, vectors)


def test_degenerate_tables(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None, "", "")])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")])).count() == 0
    # Two points differ along one line only.
    rows = whitening.whiten(frame(spark, [(None, [1.0, 2.0], "", ""), (None, [3.0, 2.0], "", ""), (7, [3.0, 2.0], "", "")])).collect()
    assert sorted(round(abs(r.whitened), 9) for r in rows) == [1.0, 1.0, 1.0] and {r.component for r in rows} == {1}
    assert rows[0].explained == pytest.approx(1.0)


def test_large_entries_and_deviations(spark):
    rows = [(k, [1e300 if k == 0 else float(k), -float(k)], "", "") for k in range(50)]
    out = whitening.whiten(frame(spark, rows)).collect()
    assert {r.deviation for r in out if r.vec_id == 0} == {None}
    n = 50
    x = [[64 * k + 1_000_000 if k else 64 * 2**40 + 1_000_000, -64 * k + 1_000_000] for k in range(n)]
    sums = [sum(c) for c in zip(*x)]
    for r in out:
        exact = sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert r.deviation == (exact if exact < 2**63 else None)
