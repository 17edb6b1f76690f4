"""Epoch orders by a keyed permutation of row numbers: an epoch is a projection.

Rows are numbered once, in a table of their own.  Row numbers below ``n`` are split into two parts,
``left`` below ``a`` and ``right`` below ``b``, and each part in turn is shifted by a hash of the other:
a Feistel network on sums.  Every shift can be undone, so places and rows are one to one.  ``a * b``
exceeds ``n`` by as little as a short search finds; the few places beyond ``n`` walk on to a free one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ROUNDS = 10
# Widths that are tried for a split with little excess.
TRIED = 4096
_INSIDE = (1 << 33) - 1


def number_rows(df: DataFrame, path: str, row: str = "row") -> DataFrame:
    """Write ``df`` with dense row numbers from 0 under ``path``, and read it.

    Rows keep the order and the partitions they have: no shuffle, no sort.  Positions are written with the rows
    before they are counted, so a scan that would come out otherwise the second time does no harm.  The table of
    offsets has one row per partition.
    """
    if {"_part", "_at", row} & set(df.columns):
        raise ValueError(f"columns _part, _at and {row} are taken")
    spark = df.sparkSession
    placed = df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(_INSIDE).alias("_at"))
    placed.write.parquet(f"{path}/rows")
    schema = placed.schema
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), "_n").write.parquet(f"{path}/offsets")
    return numbered_rows(spark, path, row)


def numbered_rows(spark: SparkSession, path: str, row: str = "row") -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows").join(F.broadcast(spark.read.parquet(f"{path}/offsets").drop("_n")), "_part")
    return rows.withColumn(row, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def n_rows(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/offsets").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


@dataclass(frozen=True)
class Permutation:
    """One order of the numbers below ``n`` for each seed and epoch."""

    n: int
    seed: int
    epoch: int

    def widths(self) -> tuple[int, int]:
        top = max(1, math.isqrt(self.n))
        tried = range(max(1, top // 2, top - TRIED), top + 1)
        a = min(tried, key=lambda width: (-self.n % width, -width))
        return a, max(1, -(-self.n // a))

    def _walked(self, df: DataFrame, number: str, out: str, back: bool) -> DataFrame:
        """One walk through all rounds, as one expression: nested projections would be pasted into each other."""
        a, b = self.widths()
        x = F.col(number)

        def shift(k: Column, part: Column, width: int) -> Column:
            return F.xxhash64(F.lit(self.seed), F.lit(self.epoch), k, part) % width

        def on(s: Column, k: Column) -> Column:
            left = F.pmod(s["left"] + shift(k * 2, s["right"], a), F.lit(a)).cast("long")
            right = F.pmod(s["right"] + shift(k * 2 + 1, left, b), F.lit(b)).cast("long")
            return F.struct(left.alias("left"), right.alias("right"))

        def undone(s: Column, k: Column) -> Column:
            right = F.pmod(s["right"] - shift(k * 2 + 1, s["left"], b), F.lit(b)).cast("long")
            left = F.pmod(s["left"] - shift(k * 2, right, a), F.lit(a)).cast("long")
            return F.struct(left.alias("left"), right.alias("right"))

        start = F.struct(F.pmod(x, F.lit(a)).cast("long").alias("left"), F.call_function("div", x, F.lit(a)).cast("long").alias("right"))
        rounds = range(ROUNDS // 2)
        order = F.array(*[F.lit(k) for k in (reversed(rounds) if back else rounds)])
        number_of = lambda s: s["right"] * a + s["left"]
        return df.withColumn(out, F.aggregate(order, start, undone if back else on, number_of))

    def _moved(self, df: DataFrame, number: str, out: str, back: bool) -> DataFrame:
        a, b = self.widths()
        df = self._walked(df, number, out, back)
        if a * b == self.n:
            return df
        # The numbers from n on, fewer than the square root of n: where a walk through them ends.
        spark = df.sparkSession
        beyond = self._walked(spark.range(self.n, a * b), "id", "to", back).collect()
        step = {r.id: r.to for r in beyond}
        ends = []
        for first in step:
            last = step[first]
            # A walk that comes back to its start is never entered from a number below n.
            while last in step and last != first:
                last = step[last]
            ends.append((first, last))
        ends = spark.createDataFrame(ends, f"`{out}` long, _end long")
        df = df.join(F.broadcast(ends), out, "left")
        return df.withColumn(out, F.coalesce("_end", out)).drop("_end")

    def places(self, df: DataFrame, row: str = "row", out: str = "shuffle_rank") -> DataFrame:
        """The place of every row in this order."""
        return self._moved(df, row, out, False)

    def rows(self, df: DataFrame, place: str = "shuffle_rank", out: str = "row") -> DataFrame:
        """The row at every place."""
        return self._moved(df, place, out, True)


def batch_columns(place: Column, micro: int, workers: int, accumulation: int) -> dict[str, Column]:
    per_slot = micro * workers
    per_step = per_slot * accumulation
    return {
        "step": F.call_function("div", place, F.lit(per_step)),
        "slot": F.call_function("div", F.pmod(place, F.lit(per_step)), F.lit(per_slot)),
        "worker": F.call_function("div", F.pmod(place, F.lit(per_slot)), F.lit(micro)),
        "position": F.pmod(place, F.lit(micro)),
    }


def epoch_order(
    rows: DataFrame, n: int, seed: int, epoch: int, micro: int, workers: int, accumulation: int, row: str = "row"
) -> DataFrame:
    """``epoch_batches`` for numbered rows: no shuffle, and no count."""
    placed = Permutation(n, seed, epoch).places(rows, row)
    return placed.withColumns(batch_columns(F.col("shuffle_rank"), micro, workers, accumulation))


def epoch_steps(
    rows: DataFrame,
    n: int,
    seed: int,
    epoch: int,
    micro: int,
    workers: int,
    accumulation: int,
    first: int,
    last: int,
    row: str = "row",
) -> DataFrame:
    """The rows of optimizer steps ``first`` to ``last`` (included) alone: what a resumed training asks for.

    The permutation is undone for their places, so the steps before are not looked at.
    """
    per_step = micro * workers * accumulation
    spark = rows.sparkSession
    places = spark.range(min(n, first * per_step), min(n, (last + 1) * per_step)).withColumnRenamed("id", "shuffle_rank")
    wanted = Permutation(n, seed, epoch).rows(places, out=row)
    return rows.join(wanted, row).withColumns(batch_columns(F.col("shuffle_rank"), micro, workers, accumulation))
