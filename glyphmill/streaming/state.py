"""Piece counts kept in a state store, and the table they are upserted into.

The store holds one counter per distinct piece and logs its changes per batch.  A batch gives the
new totals of the pieces it met.  Totals only grow, so the largest one found for a piece is the
latest: a batch that runs twice, or a run beside the ones it was merged from, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmill.model import Profile
from glyphmill.operators.counts import piece_counts
from glyphmill.session import delete

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _run(path: str, run: tuple[int, int]) -> str:
    return f"{path}/run={run[0]}-{run[1]}"


def _bytes(spark: SparkSession, path: str) -> int:
    place, files = _files(spark, path)
    return files.getContentSummary(place).getLength()


def _runs(spark: SparkSession, path: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Complete runs of batches: those to read, in order, and those that a wider one holds as well."""
    place, files = _files(spark, f"{path}/run=*/_SUCCESS")
    found = [f.getPath().getParent().getName().removeprefix("run=") for f in files.globStatus(place) or []]
    every = sorted((tuple(map(int, name.split("-"))) for name in found), key=lambda r: (r[0], -r[1]))
    kept: list[tuple[int, int]] = []
    for run in every:
        if not kept or run[1] > kept[-1][1]:
            kept.append(run)
    return kept, [r for r in every if r not in kept]


def _latest(spark: SparkSession, path: str, runs: list[tuple[int, int]]) -> DataFrame:
    rows = spark.read.schema("piece string, n long").parquet(*[_run(path, r) for r in runs])
    return rows.groupBy("piece").agg(F.max("n").alias("n"))


def upsert_totals(batch: DataFrame, batch_id: int, path: str) -> None:
    """Add the totals of a batch as a run; runs merge as soon as the one before is less than twice as large.

    Sizes at least halve from run to run, so there are about as many as the total has binary digits, and
    each row is rewritten as often.  Merged runs stay until the next batch, for readers that have listed them.
    """
    spark = batch.sparkSession
    for run in _runs(spark, path)[1]:
        delete(spark, _run(path, run))
    batch.select("piece", "n").write.mode("overwrite").parquet(_run(path, (batch_id, batch_id)))
    runs = _runs(spark, path)[0]
    while len(runs) > 1 and _bytes(spark, _run(path, runs[-2])) < 2 * _bytes(spark, _run(path, runs[-1])):
        merged = (runs[-2][0], runs[-1][1])
        _latest(spark, path, runs[-2:]).write.mode("overwrite").parquet(_run(path, merged))
        runs[-2:] = [merged]


def start_piece_state(stream: DataFrame, profile: Profile, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of all pieces so far, changed pieces upserted under ``path`` after every micro-batch.

    ``path`` and ``checkpoint`` belong together: neither is reused without the other.  How much a batch takes
    is up to the stream (``stream_corpus``); a query that was stopped or killed goes on where its log ends.
    """
    spark = stream.sparkSession
    before = {name: spark.conf.get(name, None) for name in STORE}
    writer = piece_counts(stream, profile).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    try:
        # A query keeps the settings it was started with.
        for name, value in STORE.items():
            spark.conf.set(name, value)
        return writer.foreachBatch(lambda batch, k: upsert_totals(batch, k, path)).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def piece_state(spark: SparkSession, path: str) -> DataFrame:
    """(piece, n) after the last complete batch."""
    runs = _runs(spark, path)[0]
    return _latest(spark, path, runs) if runs else spark.createDataFrame([], "piece string, n long")
