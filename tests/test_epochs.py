"""Epoch orders by permutation: one to one, undone, resumed and without a shuffle."""

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import epochs
from glyphmill.session import new_path


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 97, 1009, 40009])
def test_one_to_one_and_back(spark, n):
    order = epochs.Permutation(n, 5, 2)
    a, b = order.widths()
    assert n <= a * b < n + a and a * a <= n
    rows = order.places(spark.range(n).withColumnRenamed("id", "row"))
    assert sorted(r.shuffle_rank for r in rows.collect()) == list(range(n))
    back = order.rows(rows.drop("row").union(rows.limit(0).drop("row")))
    both = rows.join(back.withColumnRenamed("row", "again"), "shuffle_rank")
    assert both.where("row <> again").isEmpty() and both.count() == n


@pytest.mark.parametrize("n", [1009, 40009])
def test_walks_beyond_the_end(spark, monkeypatch, n):
    """With a bad split many places lie beyond the end; the order stays one to one."""
    monkeypatch.setattr(epochs.Permutation, "widths", lambda self: (200, -(-self.n // 200) + 3))
    order = epochs.Permutation(n, 1, 0)
    rows = order.places(spark.range(n).withColumnRenamed("id", "row"))
    assert sorted(r.shuffle_rank for r in rows.collect()) == list(range(n))
    back = order.rows(rows.drop("row"))
    assert rows.exceptAll(back.select(rows.columns)).isEmpty()


def test_orders_differ_and_look_random(spark):
    n = 20_000
    base = spark.range(n).withColumnRenamed("id", "row")
    one, two, three = (epochs.Permutation(n, *k).places(base) for k in ((1, 0), (1, 1), (2, 0)))
    for other in (two, three):
        assert one.join(other.withColumnRenamed("shuffle_rank", "r2"), "row").where("shuffle_rank = r2").count() < 20
    corr, near = one.agg(F.corr("row", "shuffle_rank"), F.count_if(F.abs(F.col("row") - F.col("shuffle_rank")) < 100)).first()
    # 100 places on either side of 20,000: about 1 % of the rows.
    assert abs(corr) < 0.03 and 120 < near < 280
    pairs = one.select("row", "shuffle_rank").orderBy("row").collect()
    steps = sum(b.shuffle_rank > a.shuffle_rank for a, b in zip(pairs, pairs[1:]))
    assert abs(steps - n / 2) < 4 * (n / 12) ** 0.5 + 1


def test_numbered_epochs_and_resumed_steps(spark):
    path = new_path(spark, "numbered")
    df = spark.createDataFrame([(None if k % 5 == 0 else k // 2,) for k in range(101)], "doc_id long").repartition(7)
    rows = epochs.number_rows(df, path)
    assert epochs.n_rows(spark, path) == 101
    assert sorted(r.row for r in rows.collect()) == list(range(101))
    assert sorted(r.doc_id or -1 for r in rows.collect()) == sorted(r.doc_id or -1 for r in df.collect())
    whole = epochs.epoch_order(rows, 101, 3, 1, 4, 3, 2)
    for r in whole.collect():
        p = r.shuffle_rank
        assert (r.step, r.slot, r.worker, r.position) == (p // 24, p % 24 // 12, p % 12 // 4, p % 4)
    for first, last in ((0, 0), (2, 3), (4, 9)):
        part = epochs.epoch_steps(rows, 101, 3, 1, 4, 3, 2, first, last)
        want = whole.where(F.col("step").between(first, last))
        assert sorted(map(str, part.select(whole.columns).collect())) == sorted(map(str, want.collect()))
    assert epochs.epoch_steps(rows, 101, 3, 1, 4, 3, 2, 5, 9).isEmpty()
    with pytest.raises(ValueError, match="taken"):
        epochs.number_rows(rows, new_path(spark, "again"))


def test_no_rows(spark):
    path = new_path(spark, "numbered")
    rows = epochs.number_rows(spark.range(0).withColumnRenamed("id", "doc_id"), path)
    assert epochs.n_rows(spark, path) == 0 and epochs.epoch_order(rows, 0, 1, 1, 4, 3, 2).isEmpty()


def test_an_epoch_is_a_projection(spark):
    path = new_path(spark, "numbered")
    rows = epochs.number_rows(spark.range(1000).withColumnRenamed("id", "doc_id"), path)
    text = epochs.epoch_order(rows, 1000, 3, 1, 4, 3, 2)._jdf.queryExecution().executedPlan().toString()
    for word in ("hashpartitioning", "rangepartitioning", "SinglePartition", "Sort", "Window", "Eval"):
        assert word not in text
