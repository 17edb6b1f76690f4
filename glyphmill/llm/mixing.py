"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every document draws an exponential key, scaled by its quality weight.  A source whose target
is ``e`` times its size plus a rest takes each document ``e`` times (complete epochs) and then
the documents with the smallest keys until their sizes reach the rest.

Prefix sums are taken in two steps: keys fall into buckets, bucket totals are summed within
the source, and only the one bucket where the rest ends is ranked row by row.  The number of
buckets grows with the rows, so a source that holds a third of all rows burdens no task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from glyphmill.llm.common import WORD, named
from glyphmill.session import written

# Rows that one bucket of keys holds on average.
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Quality weight of a text: one tenth, plus the share of ASCII signs and digits it lacks."""
    signs = F.length(text) - F.length(F.translate(text, "0123456789#*$%&|<>{}[]=_/\\", ""))
    return F.coalesce(F.lit(1.1) - signs / F.greatest(F.length(text), F.lit(1)), F.lit(1.1))


def uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1 that depends on key and seed alone; 52 bits of an MD5."""
    digest = F.md5(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")), "UTF-8"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Targets are ``min(most * size, share * weight)``, with the share such that they add up to
    all sizes.  Sources reach their limit in the order of size over weight, so one ordered sum
    finds the share.  Only the table of sources is ordered, never documents.
    """
    ranked = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"),
        ),
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    shared = (
        ranked.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_share", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    )
    # The first source, in this order, that stays within its limit fixes the share.
    fits = F.when(F.col("_share") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source", "_share"))
    share = F.min(fits).over(everything).getField("_share")
    return shared.withColumn("target", F.least("cap", F.coalesce(share * F.col("weight"), F.col("cap")))).select(
        "source", "source_size", "target"
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality=letter_share,
) -> DataFrame:
    """``doc_id, size, source, source_size, target, key, epochs, taken``, one row per input row.

    * null text, or one without words: size 0, takes 0 words, in any number of epochs;
    * null source: a source of its own, last in order; null doc_id: keyed like an empty id;
    * equal keys (repeated ids): ordered by id and size, so equal rows are interchangeable;
    * no rows: no rows; other columns are ignored, whatever their names.
    """
    rows = named(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = written(
        rows.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            (-F.log(uniform(F.col("doc_id"), seed)) / quality(F.col("text"))).alias("key"),
        ),
        "mix-sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"), F.avg("key").alias("_mean"))
    targets = source_targets(per_source.select("source", "source_size"), weights, most)
    plan = per_source.drop("source_size").join(targets, per_source["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    plan = plan.withColumn("_times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_times") * F.col("source_size")).withColumnRenamed("source", "_source")
    # Keys are close to exponential, so this spreads them evenly over the buckets.
    bucket = F.floor((1 - F.exp(-F.col("key") / F.col("_mean"))) * F.ceil(F.col("_rows") / F.lit(float(BUCKET_ROWS))))
    placed = sized.join(plan, sized["source"].eqNullSafe(plan["_source"])).drop("_source").withColumn("_bucket", bucket)
    totals = placed.groupBy("source", "_bucket", "_rest").agg(F.sum("size").alias("_size"))
    upto = W.partitionBy("source").orderBy("_bucket")
    totals = totals.withColumn("_before", F.sum("_size").over(upto) - F.col("_size"))
    ends = totals.where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_size") > F.col("_rest"))).select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_last"), "_before"
    )
    # No such bucket means that the rest takes in nothing or everything.
    marked = placed.join(ends, placed["source"].eqNullSafe(ends["_s"]), "left").drop("_s")
    inside = W.partitionBy("source", "_bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    edge = (
        marked.where(F.col("_bucket") == F.col("_last"))
        .withColumn("_upto", F.col("_before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        # The document on the edge is taken if that comes nearer to the target.
        .withColumn("_in", F.col("_upto") - F.col("size") / 2.0 < F.col("_rest"))
        .drop("_upto")
    )
    others = marked.where(~F.coalesce(F.col("_bucket") == F.col("_last"), F.lit(False))).withColumn(
        "_in", (F.col("_rest") > 0) & (F.col("_last").isNull() | (F.col("_bucket") < F.col("_last")))
    )
    epochs = (F.col("_times") + F.col("_in").cast("long")).alias("epochs")
    return others.unionByName(edge).select(
        "doc_id", "size", "source", "source_size", "target", "key", epochs, (F.col("size") * (F.col("_times") + F.col("_in").cast("long"))).alias("taken")
    )


def _limits(sized: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """``of, times, whole, limit`` from ``source, place``: whole epochs, and the last place that the rest takes in.

    Without a limit the rest takes in everything or nothing.  A place is key, size and text hash; rows with one place are
    summed first, so many copies of a row are one entry of their bucket.
    """
    key, size = F.col("place.key"), F.col("place.size")
    per_source = sized.groupBy("source").agg(F.sum(size).alias("source_size"), F.count("*").alias("n"), F.avg(key).alias("mean"))
    targets = source_targets(per_source.select("source", "source_size"), weights, most)
    plan = per_source.drop("source_size").join(targets, per_source["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("times", times.cast("int")).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    plan = written(plan.select(F.col("source").alias("of"), "n", "mean", "times", "rest"), "mix-plan")
    bucket = F.floor((1 - F.exp(-key / F.col("mean"))) * F.ceil(F.col("n") / F.lit(float(BUCKET_ROWS))))
    placed = sized.groupBy("source", "place").agg(F.sum(size).alias("total"))
    placed = placed.join(plan, placed["source"].eqNullSafe(plan["of"])).withColumn("bucket", bucket)
    buckets = placed.groupBy("source", "bucket", "rest").agg(F.sum("total").alias("total"))
    buckets = buckets.withColumn("before", F.sum("total").over(W.partitionBy("source").orderBy("bucket")) - F.col("total"))
    ends = buckets.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("total") > F.col("rest")) & (F.col("rest") > 0))
    ends = ends.select(F.col("source").alias("s"), F.col("bucket").alias("last"), "before")
    edge = placed.join(ends, placed["source"].eqNullSafe(ends["s"]) & (F.col("bucket") == F.col("last")))
    upto = F.col("before") + F.sum("total").over(W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    # The document on the edge is taken if that comes nearer to the target.
    taken = F.max(F.when(F.col("upto") - F.col("total") / 2.0 < F.col("rest"), F.col("place")))
    # If none of that bucket is, the place before its first one is the last.
    start = F.struct(F.min("place.key").alias("key"), F.lit(-1).cast("long").alias("size"), F.lit(0).cast("long").alias("tie"))
    reached = edge.withColumn("upto", upto).groupBy("s").agg(F.coalesce(taken, start).alias("limit"))
    found = plan.join(reached, plan["of"].eqNullSafe(reached["s"]), "left")
    return found.select("of", "times", (F.col("rest") > 0).alias("whole"), "limit")


# Sources whose limits are a table of proven size.
MOST_SOURCES = 1 << 16


def mixed_rows(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality=letter_share,
) -> DataFrame:
    """The mix itself: every row as often as its source's epochs and its own place say, with the columns it came with.

    Each row decides for itself, by its place and the limit of its source, so texts stay where they
    are; the limits of at most ``MOST_SOURCES`` sources are broadcast, more are joined.

    * null or repeated ids, null texts and null sources: as in ``mix``; rows that share an id are told
      apart by size and text, and exact copies in a source are taken together;
    * columns keep their names, whatever they are; no rows: no rows.
    """
    text, source = docs[f"`{text_col}`"], docs[f"`{source_col}`"]
    key = -F.log(uniform(docs[f"`{id_col}`"], seed)) / quality(text)
    place = F.struct(key.alias("key"), word_count(text).alias("size"), F.xxhash64(text).alias("tie")).alias("place")
    limits = written(_limits(written(docs.select(source.alias("source"), place), "mix-sizes"), weights, most), "mix-limits")
    if limits.count() <= MOST_SOURCES:
        limits = F.broadcast(limits)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), source.alias("source"), place)
    joined = rows.join(limits, rows["source"].eqNullSafe(limits["of"]))
    epochs = F.col("times") + F.coalesce(F.col("place") <= F.col("limit"), F.col("whole")).cast("int")
    copies = F.explode(F.array_repeat(F.lit(True), epochs)).alias("copy")
    return joined.select("doc", copies).select("doc.*")




ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / coalesce(1.1::DOUBLE - (length(text) - length(translate(text, '0123456789#*$%&|<>{}[]=_/\', '')))::DOUBLE
                      / greatest(length(text), 1), 1.1::DOUBLE) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM sources
), shared AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM ranked
), targets AS (
  SELECT source, source_size,
     least(cap, coalesce((SELECT share FROM shared WHERE share * weight <= cap ORDER BY cap / weight, source LIMIT 1) * weight, cap)) AS target
  FROM shared
), times AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS e FROM targets
), summed AS (
  SELECT s.*, t.source_size, t.target, t.e, t.target - t.e * t.source_size AS rest,
     sum(s.size) OVER (PARTITION BY s.source ORDER BY key, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN times t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (e + CASE WHEN rest > 0 AND upto - size / 2.0 < rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
