"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches of long texts stay small whatever the number of rows in them.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(name: str = "glyphmill", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, where driver and tasks are one machine, may fall back to a
    temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


# A table of at most this many bytes may be dealt out anew for the sake of idle cores.
SPREAD_BYTES = 256 << 20
_folders: set[str] = set()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's own folder, which goes when the driver ends."""
    folder = f"{work_dir(spark)}/glyphmill/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_drop_folder, spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _drop_folder(spark: SparkSession, folder: str) -> None:
    try:
        delete(spark, folder)
    except Exception:  # the session has ended already; nothing can be reached any more
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WorkTables:
    """Tables written for the length of one job and dropped with it.

    ``drop`` lets a long loop give back a table as soon as a newer one has replaced it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> "WorkTables":
        return self

    def __exit__(self, *error) -> None:
        while self.paths:
            self.drop()

    def write(self, df: DataFrame, label: str, by: str | Sequence[str] = (), path: str | None = None) -> DataFrame:
        """With ``by``, rows of one value lie in a folder of their own, which ``drop_rows`` can give back alone.

        With the ``path`` of an earlier table the rows are added to it.
        """
        if path is None:
            path = new_path(self.spark, label)
            self.paths.append(path)
        out = df.write.mode("append").partitionBy(by) if by else df.write.mode("append")
        out.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        return table.select(df.columns) if by else table

    def drop_rows(self, path: str, folder: str) -> None:
        delete(self.spark, f"{path}/{folder}")

    def drop(self, path: str | None = None) -> None:
        """Drop one table, or the oldest."""
        path = path or self.paths[0]
        self.paths.remove(path)
        delete(self.spark, path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a small table that has fewer splits than the session has cores.

    A file of one row group is one task, however many cores wait.  Only tables known to hold
    at most ``SPREAD_BYTES`` are moved, whatever the number of cores; larger ones are read as
    they are split.  For plain scans only: asking a shuffled frame for its partitions runs it.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
