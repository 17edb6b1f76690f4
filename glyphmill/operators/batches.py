"""Model-ready tables: labels, positions, targets, batch order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.fixed import CHECKPOINT_EVERY, IGNORED_LABEL
from glyphmill.operators.lengths import hash_order

_NO_INTS = "array<int>"
GROUP_ROWS = 1 << 20


def lm_labels(ids: Column, pad_token_id: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad_token_id, IGNORED_LABEL).otherwise(x))


def position_ids(ids: Column) -> Column:
    """0 to n-1, padding included."""
    return F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1)).otherwise(F.array().cast(_NO_INTS))


def next_token_pairs(df: DataFrame, ids: str = "input_ids", labels: str = "labels", key: str = "doc_id") -> DataFrame:
    """(key, position, token_id, target_id): each position and the label after it."""
    pairs = F.arrays_zip(
        F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))).alias("token_id"),
        F.slice(F.col(labels), 2, F.greatest(F.size(labels) - 1, F.lit(0))).alias("target_id"),
    )
    rows = df.select(key, F.posexplode(pairs).alias("position", "pair"))
    return rows.select(key, "position", "pair.token_id", "pair.target_id").where(F.col("target_id") != IGNORED_LABEL)


def last_real_token(ids: Column, pad_token_id: int) -> Column:
    """Rightmost position that is not padding; 0 when all is."""
    places = F.transform(ids, lambda x, i: F.when(x != pad_token_id, i).otherwise(0))
    return F.coalesce(F.array_max(places), F.lit(0))


def epoch_batches(
    df: DataFrame,
    seed: int,
    epoch: int,
    micro: int,
    workers: int,
    accumulation: int,
    key: str = "doc_id",
    prefix: int | None = None,
) -> DataFrame:
    """Every row's optimizer step, accumulation slot, worker and position in a seeded order.

    Ranks come from counts per hash prefix plus the rank inside the prefix, so no task sorts
    the whole table.  ``prefix`` hex digits give 16**prefix groups of near-equal size; that
    number, a million at most, also bounds the offset table, which is broadcast.  By default it
    follows from the number of rows, so that a group holds about a million.
    """
    if prefix is None:
        prefix = min(5, max(1, math.ceil(math.log(max(1, df.count() / GROUP_ROWS), 16))))
    if not 1 <= prefix <= 5:
        raise ValueError("prefix must be 1 to 5 hex digits")
    tagged = df.withColumn("_order", hash_order(f"{seed}:{epoch}", key))
    tagged = tagged.withColumn("_bits", F.substring("_order", 1, prefix))
    sizes = df.select(F.substring(hash_order(f"{seed}:{epoch}", key), 1, prefix).alias("_bits"))
    sizes = sizes.groupBy("_bits").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_bits").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bits", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bits").orderBy("_order", key)) - 1
    ranked = tagged.withColumn("_inside", inside).join(F.broadcast(offsets), "_bits")
    place = F.col("_offset") + F.col("_inside")
    per_slot = micro * workers
    per_step = per_slot * accumulation
    return ranked.withColumns(
        {
            "shuffle_rank": place,
            "step": F.floor(place / per_step),
            "slot": F.floor(F.pmod(place, F.lit(per_step)) / per_slot),
            "worker": F.floor(F.pmod(place, F.lit(per_slot)) / micro),
            "position": F.pmod(place, F.lit(micro)),
        }
    ).drop("_bits", "_order", "_inside", "_offset")


def epoch_summary(df: DataFrame, micro: int, workers: int, accumulation: int, epochs: int) -> DataFrame:
    """Row count, global batch, steps, and how many checkpoints fall within them."""
    total = F.col("steps_per_epoch") * epochs
    return (
        df.agg(F.count("*").alias("n_rows"))
        .withColumn("global_batch", F.lit(micro * workers * accumulation))
        .withColumn("steps_per_epoch", F.ceil(F.col("n_rows") / F.col("global_batch")))
        .withColumn("total_steps", total)
        .withColumn("n_checkpoints", F.floor(F.col("total_steps") / CHECKPOINT_EVERY))
    )
