"""Connected components of a links table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphmill.session import WorkTables


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour to the least node in sight."""
    both = _both(edges)
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = _least(down)
    return down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )


def components(links: DataFrame, work: WorkTables) -> DataFrame:
    """``a, b``: for every linked node but the least of a component, that least node.

    ``links`` has columns ``a, b``.  Every round is one grouping and one join on nodes; a node
    with very many links is grouped by a partial minimum and its join side is split by the
    planner.  Rounds grow with the logarithm of the longest path.  Tables go to ``work``, the
    last is one that its caller must read before ``work`` is left.
    """
    edges = work.write(links.where("a <> b").distinct(), "links")
    known = None
    while True:
        edges = work.write(_small_star(work.write(_large_star(edges).distinct(), "links")).distinct(), "links")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == known:
            return edges
        known = state
