"""Writing corpora and token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_jsonl(df: DataFrame, path: str, shard: str | None = None) -> None:
    """All columns with explicit nulls; ``shard`` keeps the rows of one input file in one folder."""
    writer = df
    if shard:
        writer = df.withColumn("shard", F.col(shard))
    out = writer.write.option("ignoreNullFields", False)
    (out.partitionBy("shard") if shard else out).json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """The value and a line feed; line feeds inside make further lines."""
    df.select(column).write.option("lineSep", "\n").text(path)


def write_tokens(df: DataFrame, path: str, split: str = "train") -> None:
    df.withColumn("split", F.lit(split)).write.mode("append").partitionBy("split").parquet(path)


def read_tokens(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")
