"""Corpus statistics: samples, token lengths, compression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glyphmill.fixed import HEADROOM, LENGTH_PERCENTILES, SAMPLE_ROWS_PER_FILE
from glyphmill.model import BpeModel
from glyphmill.operators.codec import encode


def hash_order(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_per_file(
    df: DataFrame, n: int = SAMPLE_ROWS_PER_FILE, seed: int = 0, file: str = "source", key: str = "doc_id"
) -> DataFrame:
    """At most ``n`` rows per file in seeded hash order.

    A first pass over file and key alone counts rows per hash prefix and finds, per file, the
    prefix where ``n`` rows are reached.  Only rows up to it are ranked, so even a file with
    a third of the corpus sends little more than ``n`` rows to its window.
    """
    bits = F.substring(hash_order(seed, key), 1, 3)
    counts = df.select(F.col(file), bits.alias("_bits")).groupBy(file, "_bits").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(file).orderBy("_bits").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    cutoffs = counts.where(F.col("_before") < n).groupBy(file).agg(F.max("_bits").alias("_cutoff"))
    near = df.join(cutoffs, file).where(bits <= F.col("_cutoff")).drop("_cutoff")
    ranked = near.withColumn("_order", hash_order(seed, key))
    place = F.row_number().over(Window.partitionBy(file).orderBy("_order", key))
    return ranked.withColumn("_place", place).where(F.col("_place") <= n).drop("_place", "_order").select(df.columns)


def token_lengths(df: DataFrame, model: BpeModel | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Tokens per row; without a model every byte is a token."""
    if model is None:
        return df.withColumn(out, F.octet_length(text))
    return encode(df, model, text, "_ids").withColumn(out, F.size("_ids")).drop("_ids")


def _percentile(share: float, length: str) -> Column:
    return F.percentile(length, F.lit(share))


def length_stats_per_file(df: DataFrame, file: str = "source", length: str = "n_tokens") -> DataFrame:
    """Exact percentiles keep one counter per distinct length, merged map-side."""
    percentiles = [_percentile(p, length).alias(f"p{round(p * 100)}") for p in LENGTH_PERCENTILES]
    return df.groupBy(file).agg(
        F.count("*").alias("count"),
        F.avg(length).alias("mean"),
        F.stddev_pop(length).alias("std"),
        F.min(length).alias("min"),
        F.max(length).alias("max"),
        *percentiles,
    )


def recommended_max_length(length: str = "n_tokens") -> Column:
    return (_percentile(0.95, length) * F.lit(HEADROOM)).cast("int")


def length_stats_global(df: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Over the pooled rows: percentiles of files do not combine."""
    return df.agg(
        F.count("*").alias("total_samples"),
        F.avg(length).alias("global_mean"),
        F.max(length).alias("global_max"),
        _percentile(0.95, length).alias("global_95_percentile"),
        recommended_max_length(length).alias("recommended_max_length"),
    )


def compression_rate(df: DataFrame, model: BpeModel | None = None, text: str = "text", by: str | None = None) -> DataFrame:
    """Characters per token over non-empty texts; ratios are null when there are none."""
    rows = token_lengths(df.where(F.length(text) > 0), model, text, "_tokens")
    totals = (rows.groupBy(by) if by else rows.groupBy()).agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"),
        F.coalesce(F.sum("_tokens"), F.lit(0)).alias("n_tokens"),
    )
    return _ratios(totals)


def _ratios(totals: DataFrame) -> DataFrame:
    return totals.withColumns(
        {
            "chars_per_token": F.try_divide("n_chars", "n_tokens"),
            "chars_per_row": F.try_divide("n_chars", "n_rows"),
            "tokens_per_row": F.try_divide("n_tokens", "n_rows"),
        }
    )


def length_histogram(
    df: DataFrame, model: BpeModel | None = None, by: Sequence[str] = ("source",), text: str = "text"
) -> DataFrame:
    """(keys, n_tokens, n_rows, n_texts, n_chars): the one encoding that all statistics below are read from.

    One row per key and distinct length: its rows, those with a text that is not empty, and their
    characters.  Rows are counted before the shuffle, so a key with a third of the corpus stays cheap.
    """
    some = F.coalesce(F.length(text) > 0, F.lit(False))
    rows = token_lengths(df.select(*by, text), model, text, "n_tokens")
    return rows.groupBy(*by, F.col("n_tokens").cast("long").alias("n_tokens")).agg(
        F.count("*").alias("n_rows"),
        F.count_if(some).alias("n_texts"),
        F.coalesce(F.sum(F.when(some, F.length(text).cast("long"))), F.lit(0)).alias("n_chars"),
    )


def keep_histogram(histogram: DataFrame, path: str, shard: str) -> None:
    """Put a shard's histogram under ``path``, in place of an earlier one of the same name; others stay untouched."""
    out = histogram.withColumn("shard", F.lit(shard)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("shard").parquet(path)


def kept_histogram(spark: SparkSession, path: str) -> DataFrame:
    """The histograms of all shards as one."""
    rows = spark.read.parquet(path).drop("shard")
    keys = [c for c in rows.columns if c not in _TOTALS]
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _TOTALS])


_TOTALS = ("n_rows", "n_texts", "n_chars")


def _weighted_percentile(share: float) -> Column:
    return F.expr(f"percentile(n_tokens, {share}D, n_rows)")


def _weighted() -> dict[str, Column]:
    """Count, mean, deviation, extremes and percentiles of a histogram's lengths; sums are whole numbers."""
    wide = "decimal(38,0)"
    n = F.sum(F.when(F.col("n_tokens").isNotNull(), F.col("n_rows"))).cast(wide)
    total = F.sum(F.col("n_tokens").cast(wide) * F.col("n_rows"))
    squares = F.sum(F.col("n_tokens").cast(wide) * F.col("n_tokens") * F.col("n_rows"))
    spread = (n * squares - total * total).cast("double")
    return {
        "count": F.sum("n_rows"),
        "mean": F.try_divide(total.cast("double"), n.cast("double")),
        "std": F.try_divide(F.sqrt(spread), n.cast("double")),
        "min": F.min("n_tokens"),
        "max": F.max("n_tokens"),
    }


def histogram_stats(histogram: DataFrame, by: str | None = "source") -> DataFrame:
    """``length_stats_per_file`` from a histogram; pooled over all keys without ``by``."""
    percentiles = [_weighted_percentile(p).alias(f"p{round(p * 100)}") for p in LENGTH_PERCENTILES]
    own = [c.alias(name) for name, c in _weighted().items()]
    best = (_weighted_percentile(0.95) * F.lit(HEADROOM)).cast("int").alias("recommended_max_length")
    return (histogram.groupBy(by) if by else histogram.groupBy()).agg(*own, *percentiles, best)


def histogram_compression(histogram: DataFrame, by: str | None = None) -> DataFrame:
    """``compression_rate`` from a histogram: an empty text has no tokens, so it adds to rows only."""
    tokens = F.sum(F.when(F.col("n_texts") > 0, F.col("n_tokens") * F.col("n_texts")))
    totals = (histogram.groupBy(by) if by else histogram.groupBy()).agg(
        F.coalesce(F.sum("n_texts"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"),
        F.coalesce(tokens, F.lit(0)).alias("n_tokens"),
    )
    return _ratios(totals.where("n_rows > 0") if by else totals)


def corpus_counts(df: DataFrame, file: str = "source") -> DataFrame:
    """Files are counted from their per-file row counts: no distinct over all rows."""
    per_file = df.groupBy(file).agg(F.count("*").alias("n"))
    return per_file.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
