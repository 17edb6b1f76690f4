"""Sharding over fixed virtual slots.

A record's slot is a hash of its id (of its text, where it has none) and never changes.  Bytes are
summed per slot, and a stored map says which shard holds each slot.  The first run over a map's
folder writes version 1; later ones edit the latest version, moving as few slots as possible, write
it as the next one if anything moved, and leave the records' slots alone.  Rows are placed by what
has been read back from the folder.

Only the map (``SLOTS`` rows, a fixed bound) is ever handled by the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from glyphmill.llm.common import named
from glyphmill.session import new_path, written

SLOTS = 16384
RECORD_BYTES = 16


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    hashed = F.when(key.isNotNull(), F.xxhash64(key.cast("string"))).otherwise(F.xxhash64(text))
    return F.pmod(hashed, F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """Bytes by slot of ``virtual_slot, size`` rows: ``SLOTS`` rows at most reach the driver."""
    return {r.virtual_slot: r.b for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()}


def first_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 1: the heaviest slot first, each to the lightest shard.  Slots without rows go round."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for slot in sorted(range(slots), key=lambda k: (-loads.get(k, 0), k)):
        load, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (load + max(1, loads.get(slot, 0)), shard))
    return placed


def rebalanced_map(placed: dict[int, int], loads: dict[int, int], shards: int) -> dict[int, int]:
    """The next version for ``shards`` shards.

    Shards that no longer exist give up all slots, those above the mean give up their lightest
    slots until they are not above it by more than their lightest slot; what was given up goes,
    heaviest first, to the lightest shards.  Everything else stays where it is.
    """
    new, mean = dict(placed), sum(loads.values()) / shards
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    moving = []
    for slot, shard in placed.items():
        (held[shard] if shard < shards else moving).append(slot)
    total = {s: sum(loads.get(k, 0) for k in own) for s, own in held.items()}
    for s, own in held.items():
        for slot in sorted(own, key=lambda k: (loads.get(k, 0), k)):
            load = loads.get(slot, 0)
            if load and total[s] - load >= mean:
                total[s] -= load
                moving.append(slot)
    heap = [(total[s], s) for s in held]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda k: (-loads.get(k, 0), k)):
        load, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), shard))
    return new


def save_map(spark: SparkSession, path: str, version: int, placed: dict[int, int]) -> None:
    """Add a version to the stored map; a version is written once and never changed."""
    rows = spark.createDataFrame([(version, k, v) for k, v in sorted(placed.items())], "version int, virtual_slot int, shard int")
    rows.coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/version={version:08d}")


def load_map(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    rows = spark.read.parquet(f"{path.rstrip('/')}/version={version:08d}")
    return {r.virtual_slot: r.shard for r in rows.collect()}


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The highest version that has been written to its end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path.rstrip("/"))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = files.globStatus(hadoop(f"{path.rstrip('/')}/version=*/_SUCCESS")) or []
    return max((int(f.getPath().getParent().getName().removeprefix("version=")) for f in done), default=None)


def current_map(spark: SparkSession, path: str, loads: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """The map of a folder for these loads: its first version, or its latest one edited, as it is stored."""
    version = latest_version(spark, path)
    if version is None:
        save_map(spark, path, 1, first_map(loads, shards, slots))
        return load_map(spark, path, 1)
    old = load_map(spark, path, version)
    if len(old) != slots:
        raise ValueError(f"the stored map has {len(old)} slots, not {slots}")
    new = rebalanced_map(old, loads, shards)
    if new == old:
        return old
    save_map(spark, path, version + 1, new)
    return load_map(spark, path, version + 1)


def place(placed: dict[int, int]) -> Column:
    """The shard of ``virtual_slot`` under a map, as a lookup in a constant array of fixed length."""
    shards = ",".join(str(placed[k]) for k in range(len(placed)))
    return F.element_at(F.split(F.lit(shards), ","), F.col("virtual_slot") + 1).cast("int")


def shard_documents(
    docs: DataFrame, shards: int = 40, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None
) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, shard, slot`` per row; ``slot`` numbers the rows of a shard from 0.

    * null text: no bytes, checksum of the empty text; null doc_id: the slot of its text;
    * repeated ids share slot and shard, equal rows get different numbers in either order;
    * no rows: no rows; other columns are ignored, whatever their names.

    A record larger than the mean shard leaves its shard above it: records are never cut.  The map
    lives in ``map_path``, or in a folder of this run.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = named(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot"),
    )
    rows = written(rows, "shard-sizes")
    placed = current_map(spark, map_path or new_path(spark, "shard-map"), slot_bytes(rows), shards, slots)
    # Rows are numbered within their slot; the slots of a shard follow one another.
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("_n")).withColumn("shard", place(placed))
    ahead = F.sum("_n").over(W.partitionBy("shard").orderBy("virtual_slot")) - F.col("_n")
    starts = counts.select("virtual_slot", "shard", ahead.alias("_ahead"))
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_at", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("_ahead") + F.col("_at")).cast("long").alias("slot"))
    )


def sharded_rows(
    docs: DataFrame, shards: int = 40, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None
) -> DataFrame:
    """``docs`` with ``virtual_slot`` and ``shard`` (in place of columns of these names); texts are not moved."""
    spark = docs.sparkSession
    sizes = named(docs, doc_id=id_col, text=text_col).select(
        virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot"), record_size(F.col("text")).alias("size")
    )
    placed = current_map(spark, map_path or new_path(spark, "shard-map"), slot_bytes(sizes), shards, slots)
    rows = docs.withColumn("virtual_slot", virtual_slot(docs[f"`{id_col}`"], docs[f"`{text_col}`"], slots))
    return rows.withColumn("shard", place(placed))
