"""Statistics, batch order, routing and vocabulary tables."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F
from test_training import TINY, texts

from glyphmill.model import VOCAB_SCHEMA
from glyphmill.operators import batches, lengths, routing, training, vocabulary


def test_length_statistics(spark):
    df = spark.createDataFrame([("f", n) for n in range(11)] + [("g", 3)], "source string, n_tokens int")
    rows = {r.source: r for r in lengths.length_stats_per_file(df).collect()}
    f = rows["f"]
    assert (f["count"], f["mean"], f["min"], f["max"], f.p50, f.p95) == (11, 5.0, 0, 10, 5.0, 9.5)
    assert math.isclose(f.std, 3.16227766, rel_tol=1e-8) and rows["g"].std == 0.0
    whole = lengths.length_stats_global(df.where("source = 'f'")).first()
    assert whole.recommended_max_length == 9 and whole.global_95_percentile == 9.5


def test_compression_of_nothing(spark):
    row = lengths.compression_rate(texts(spark, "", "")).first()
    assert (row.n_rows, row.n_chars, row.n_tokens, row.chars_per_token) == (0, 0, 0, None)
    row = lengths.compression_rate(texts(spark, "é", "")).first()
    assert (row.n_rows, row.n_chars, row.n_tokens, row.chars_per_token) == (1, 1, 2, 0.5)


@pytest.mark.parametrize("n", [1, 7, 400, 5000])
def test_sample_with_one_hot_file(spark, n):
    """One file holds most rows; the sample equals sorting each file in one place."""
    files = [(i, "hot" if i % 3 else f"f{i % 7}") for i in range(6000)]
    df = spark.createDataFrame(files, "doc_id long, source string")
    got = sorted((r.source, r.doc_id) for r in lengths.sample_per_file(df, n, 5).collect())
    want = []
    for name in {f for _, f in files}:
        keys = sorted((hashlib.md5(f"5:{i}".encode()).hexdigest(), i) for i, f in files if f == name)
        want += [(name, i) for _, i in keys[:n]]
    assert got == sorted(want)


@pytest.mark.parametrize("prefix", [1, 2, 3])
def test_epoch_order(spark, prefix):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    rows = batches.epoch_batches(df, 1, 0, 4, 3, 2, prefix=prefix).orderBy("shuffle_rank").collect()
    order = sorted(range(1000), key=lambda i: (hashlib.md5(f"1:0:{i}".encode()).hexdigest(), i))
    assert [r.doc_id for r in rows] == order
    for rank, r in enumerate(rows):
        assert (r.step, r.slot, r.worker, r.position) == (rank // 24, rank % 24 // 12, rank % 12 // 4, rank % 4)
    other = batches.epoch_batches(df, 1, 1, 4, 3, 2).orderBy("shuffle_rank").limit(50).collect()
    assert [r.doc_id for r in other] != order[:50]


def test_labels_and_positions(spark):
    df = spark.createDataFrame([(0, [9, 8, 10, 8, 0, 0]), (1, [0, 0]), (2, []), (3, [0, 5])], "doc_id int, input_ids array<int>")
    ids = F.col("input_ids")
    df = df.withColumns(
        {"labels": batches.lm_labels(ids, 0), "pos": batches.position_ids(ids), "last": batches.last_real_token(ids, 0)}
    )
    rows = df.orderBy("doc_id").collect()
    assert rows[0].labels == [9, 8, 10, 8, -100, -100] and rows[0].pos == [0, 1, 2, 3, 4, 5]
    assert [r["last"] for r in rows] == [3, 0, 0, 1] and rows[2].pos == []
    pairs = sorted(tuple(r) for r in batches.next_token_pairs(df).collect())
    assert pairs == [(0, 0, 9, 8), (0, 1, 8, 10), (0, 2, 10, 8), (3, 0, 0, 5)]


def test_epoch_summary(spark):
    row = batches.epoch_summary(spark.range(100), 16, 2, 1, 3).first()
    assert (row.n_rows, row.global_batch, row.steps_per_epoch, row.total_steps) == (100, 32, 4, 12)


def test_expert_load(spark):
    rng = random.Random(3)
    logits = [[rng.gauss(0, 2) for _ in range(4)] for _ in range(50)] + [[1.0, 1.0, 1.0, 1.0]]
    mask = [i % 3 != 0 for i in range(51)]
    df = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate(zip(logits, mask))], "vec_id int, logits array<double>, m boolean")
    weights = [float(m) for m in mask]
    probs = [[math.exp(x) / sum(map(math.exp, v)) for x in v] for v in logits]
    best = [sorted(range(4), key=lambda e: (-p[e], e))[:2] for p in probs]
    got = {(r.slot, r.expert): r for r in routing.expert_load(df, 2, mask=F.col("m")).collect()}
    imbalance = 0.0
    for s in range(2):
        for e in range(4):
            share = sum(w for w, b in zip(weights, best) if b[s] == e) / sum(weights)
            mean = sum(w * p[e] for w, p in zip(weights, probs)) / sum(weights)
            imbalance += 4 * share * mean
            assert math.isclose(got[s, e].share, share, abs_tol=1e-12)
            assert math.isclose(got[s, e].probability, mean, rel_tol=1e-9)
    assert all(math.isclose(r.imbalance, imbalance, rel_tol=1e-9) for r in got.values())
    top = routing.route_topk(df, 2, renorm=True).where("vec_id = 50").orderBy("slot").collect()
    assert [(r.slot, r.expert, r.weight) for r in top] == [(0, 0, 0.5), (1, 1, 0.5)]


def vocab(spark, tokens):
    return spark.createDataFrame([(t, i, "merge", -1.0, "") for i, t in enumerate(tokens)], VOCAB_SCHEMA)


def test_merged_vocabularies(spark):
    rows = vocabulary.merge_vocab(vocab(spark, "abc"), vocab(spark, "bddae")).orderBy("token_id").collect()
    assert [r.token for r in rows] == list("abcde")
    assert [r.token_id for r in rows] == [0, 1, 2, 3, 4] and [r.score for r in rows] == [-1.0] * 3 + [0.0] * 2
    rows = vocabulary.expand_vocab(vocab(spark, "ab"), ["拉", "b", "拉"]).orderBy("token_id").collect()
    assert [(r.token_id, r.token) for r in rows][2:] == [(2, "拉")]


def test_added_tokens(spark):
    model = training.train_bpe(texts(spark, "ab ab"), 100, 1, TINY)
    size = vocabulary.vocab_size(model).first().vocab_size
    more = vocabulary.add_tokens(model, ["<A>", "<|endoftext|>", "<A>", "ab"])
    added = {r.content: (r.token_id, r.special) for r in more.added_tokens.collect()}
    assert added == {"<|endoftext|>": (0, True), "<|im_start|>": (1, True), "<A>": (size, False), "ab": (vocabulary.token_id(model, "ab"), False)}
    assert vocabulary.vocab_size(more).first().vocab_size == size


def test_a_fully_masked_log_gives_nulls(spark):
    from glyphmill.operators import routing

    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id int, logits array<double>")
    rows = routing.expert_load(df, 1, mask=F.lit(False)).collect()
    assert len(rows) == 2 and {(r.share, r.probability, r.imbalance) for r in rows} == {(None, None, None)}


def test_training_rows_have_token_types(spark, documents):
    from glyphmill.operators.codec import build_training_rows
    from glyphmill.operators.training import train_bpe

    model = train_bpe(documents.limit(3), None, max_merges=2)
    rows = build_training_rows(documents.limit(3), model, 16).collect()
    assert {tuple(r.token_type_ids) for r in rows} == {(0,) * 16}
