"""Length statistics from a kept histogram against those over rows."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import lengths


def frame(spark, seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.choice(["x", None]), rng.choice([None, "", "ü" * rng.randrange(40), "z" * rng.randrange(9)])) for _ in range(n)]
    return spark.createDataFrame(rows, "source string, lang string, text string")


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g.keys() == w.keys()
        for k in w:
            assert g[k] == (pytest.approx(w[k], rel=1e-9) if isinstance(w[k], float) else w[k]), k


def rows_of(df, key):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(r.get(key)))


@pytest.mark.parametrize("n", [1, 400])
def test_statistics_equal_those_over_rows(spark, n):
    df = frame(spark, n, n)
    held = lengths.length_histogram(df, by=["source", "lang"])
    rows = lengths.token_lengths(df)
    best = rows.groupBy("source").agg(lengths.recommended_max_length().alias("recommended_max_length"))
    want = lengths.length_stats_per_file(rows).join(best, "source")
    near(rows_of(lengths.histogram_stats(held), "source"), rows_of(want, "source"))
    pooled, whole = lengths.histogram_stats(held, None).first(), lengths.length_stats_global(rows).first()
    assert (pooled["count"], pooled["max"], pooled.recommended_max_length) == (whole.total_samples, whole.global_max, whole.recommended_max_length)
    for by in (None, "lang"):
        near(rows_of(lengths.histogram_compression(held, by), "lang"), rows_of(lengths.compression_rate(df, by=by), "lang"))


def test_no_rows(spark):
    held = lengths.length_histogram(frame(spark, 0, 1).where("false"))
    assert lengths.histogram_stats(held).isEmpty() and lengths.histogram_compression(held, "source").isEmpty()
    pooled, rate = lengths.histogram_stats(held, None).first(), lengths.histogram_compression(held).first()
    assert (pooled["mean"], pooled.p95, rate.n_rows, rate.chars_per_token) == (None, None, 0, None)


def test_shards_are_merged_and_replaced(spark, tmp_path):
    shards = [frame(spark, k, 100) for k in range(3)]
    path = f"{tmp_path}/histogram"
    for k, df in enumerate(shards[:2]):
        lengths.keep_histogram(lengths.length_histogram(df), path, f"s{k}")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "histogram").glob("shard=s0/*.parquet")}
    lengths.keep_histogram(lengths.length_histogram(shards[2]), path, "s1")
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "histogram").glob("shard=s0/*.parquet")}
    whole = lengths.length_histogram(shards[0].union(shards[2]))
    kept = lengths.kept_histogram(spark, path).select(whole.columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, whole.collect()))


def test_one_encoding_and_little_shuffled(spark):
    held = lengths.length_histogram(frame(spark, 1, 50))
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
