"""Lazily read corpora: ingestion, incremental piece counts, encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmill.fixed import MAX_LENGTH
from glyphmill.model import BpeModel, Profile
from glyphmill.operators.codec import build_training_rows
from glyphmill.operators.counts import piece_counts


_BAD = "_corrupt_record"


def stream_corpus(
    spark: SparkSession,
    folder: str,
    fmt: str = "text",
    schema: str = "text string",
    max_files: int | None = None,
    max_bytes: int | None = None,
    on_bad: str = "strict",
) -> DataFrame:
    """A stream of ``text`` rows from a folder of text, JSON lines or parquet files.

    A micro-batch takes at most ``max_files`` files or about ``max_bytes`` (at least one file); without a
    bound it takes all there are.  ``strict`` stops at the first bad JSON line or broken parquet file, and
    goes on there after it was mended; ``skip`` leaves bad lines and what cannot be read of a broken
    file out.  JSON rows without text are bad lines.  ``progress`` reports how many rows were read and left out.
    """
    if on_bad not in ("strict", "skip"):
        raise ValueError("on_bad is strict or skip")
    if max_files is not None and max_bytes is not None:
        raise ValueError("a batch is bounded by files or by bytes")
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if fmt == "text":
        df = reader.option("lineSep", "\n").text(folder).withColumnRenamed("value", "text")
        return _observed(df, F.lit(False))
    if fmt == "parquet":
        df = reader.option("ignoreCorruptFiles", on_bad == "skip").schema(schema).parquet(folder)
        return _observed(df, F.lit(False))
    if on_bad == "strict":
        df = reader.option("mode", "FAILFAST").schema(schema).json(folder)
        missing = F.raise_error(F.lit("a line without text")).cast("boolean")
        return _observed(df.where(F.when(F.col("text").isNull(), missing).otherwise(F.lit(True))), F.lit(False))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD)
    df = reader.schema(f"{schema}, {_BAD} string").json(folder)
    bad = F.col(_BAD).isNotNull() | F.col("text").isNull()
    return _observed(df, bad).where(~bad).drop(_BAD)


def _observed(df: DataFrame, bad: Column) -> DataFrame:
    return df.observe("corpus", F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"))


def progress(query: StreamingQuery) -> list[dict]:
    """Of the latest batches that read rows: batch, rows, rows left out, milliseconds."""
    out = []
    for p in query.recentProgress:
        metrics = p.observedMetrics.get("corpus")
        if metrics is not None and metrics.n_rows:
            out.append({"batch": p.batchId, "n_rows": metrics.n_rows, "n_bad": metrics.n_bad, "ms": p.batchDuration})
    return out


def start_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything available now, to parquet, exactly once."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def start_piece_counts(stream: DataFrame, profile: Profile, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of each micro-batch under their own folder.

    A repeated batch replaces its folder, so counts stay exact after a restart, and no
    growing state has to be held or rewritten between batches.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        piece_counts(batch, profile).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def streamed_piece_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("piece").agg(F.sum("n").alias("n"))


def start_encode(
    stream: DataFrame,
    model: BpeModel,
    path: str,
    checkpoint: str,
    max_length: int = MAX_LENGTH,
    key: str = "doc_id",
) -> StreamingQuery:
    """Training rows of a stream; the same projection as in batch, without state."""
    return start_append(build_training_rows(stream, model, max_length, key=key), path, checkpoint)
