"""Reports over logged expert-router logits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.functions.binding import let


def _probabilities(logits: Column) -> Column:
    """Stable softmax.  Each step is bound: the planner would put a column of its own back into the next step's lambda."""

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda s: F.transform(powers, lambda x: x / s))

    return let(logits, lambda own: let(F.array_max(own), lambda top: let(F.transform(own, lambda x: F.exp(x - top)), shares)))


def _chosen(p: Column, k: int) -> Column:
    """The k likeliest experts of a row as (slot, expert, weight); ties go to the lower expert."""
    pairs = F.transform(p, lambda p, i: F.struct((-p).alias("w"), i.alias("expert")))
    best = F.slice(F.sort_array(pairs), 1, k)
    return F.transform(best, lambda b, s: F.struct(s.alias("slot"), b.expert.alias("expert"), (-b.w).alias("weight")))


def _weighted(best: Column, total: Column) -> Column:
    return F.transform(best, lambda b: F.struct(b.slot.alias("slot"), b.expert.alias("expert"), (b.weight / total).alias("weight")))


def route_topk(
    df: DataFrame, k: int, renorm: bool, logits: str = "logits", keys: Sequence[str] = ("vec_id",)
) -> DataFrame:
    """(keys, slot, expert, weight), all inside the row: no shuffle."""

    def weights(best: Column) -> Column:
        total = F.aggregate(best, F.lit(0.0), lambda a, b: a + b.weight) if renorm else F.lit(1.0)
        return let(total, lambda t: _weighted(best, t))

    best = let(_chosen(_probabilities(F.col(logits)), k), weights)
    # Outer, for else the planner computes the array once more to leave out empty ones before.
    return df.select(*keys, F.inline_outer(best)).where(F.col("slot").isNotNull())


def expert_load(df: DataFrame, k: int, logits: str = "logits", mask: Column | None = None) -> DataFrame:
    """(slot, expert, share, probability, imbalance) over all layers and tokens pooled.

    ``share`` is the part of tokens whose slot went to the expert, ``probability`` the
    expert's mean probability; imbalance is experts * sum(share * probability) and the same
    on every row.  ``mask`` weighs rows, for padding; where it leaves none, all three are null.  Both sums combine map-side and leave
    at most slots * experts rows.
    """
    weight = F.lit(1.0) if mask is None else mask.cast("double")

    # One element per expert: its probability and, if chosen, the slot it filled.
    def slots(p: Column) -> Column:
        return let(_chosen(p, k), lambda best: F.transform(p, lambda own, i: cell(best, own, i)))

    def cell(best: Column, own: Column, i: Column) -> Column:
        filled = F.transform(F.filter(best, lambda b: b.expert == i), lambda b: b.slot)
        return F.struct(i.alias("expert"), own.alias("p"), F.element_at(F.concat(filled, F.array(F.lit(-1))), 1).alias("slot"))

    rows = df.select(weight.alias("_w"), F.inline_outer(let(_probabilities(F.col(logits)), slots)))
    cells = rows.where(F.col("expert").isNotNull()).groupBy("expert", "slot")
    cells = cells.agg(F.sum("_w").alias("filled"), F.sum(F.col("p") * F.col("_w")).alias("mass"))
    experts = cells.groupBy("expert").agg(
        F.sum("filled").alias("total"),
        F.sum("mass").alias("mass"),
        F.map_from_entries(F.collect_list(F.struct("slot", "filled"))).alias("by_slot"),
    )
    table = experts.select(
        "expert",
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"),
        "by_slot",
        "total",
        F.try_divide("mass", "total").alias("probability"),
    ).withColumn("share", F.try_divide(F.coalesce(F.try_element_at("by_slot", F.col("slot")), F.lit(0.0)), F.col("total")))
    # The window covers slots * experts rows, whatever the size of the log.
    everything = Window.partitionBy()
    imbalance = (F.max("expert").over(everything) + 1) * F.sum(F.col("share") * F.col("probability")).over(everything)
    return table.select("slot", "expert", "share", "probability", imbalance.alias("imbalance"))
