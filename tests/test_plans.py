"""The plans the library is meant to produce."""

import re

import pytest
from pyspark.sql import functions as F

from glyphmill.model import BYTE_LEVEL
from glyphmill.operators import batches, chat, codec, counts, lengths, routing
from glyphmill.plans import queries
from glyphmill.session import WorkTables, spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def model(spark, sf_small):
    return queries.other_model(spark, sf_small)


def test_encoding_is_one_projection(spark, documents, model):
    rows = codec.build_training_rows(documents, model, 128)
    text = plan(rows.withColumn("labels", batches.lm_labels(F.col("input_ids"), 0)))
    # One step normalises the texts that need it, one encodes.
    assert text.count("ArrowEvalPython [") == 2
    assert "Exchange" not in text and "Join" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_decoding_stays_in_the_jvm(spark, model):
    ids = spark.createDataFrame([(1, [1, 2])], "doc_id int, input_ids array<int>")
    text = plan(codec.decode(ids, model))
    assert "Python" not in text and "Exchange" not in text


def test_counting_combines_before_its_only_shuffle(spark, documents):
    text = plan(counts.piece_counts(documents, BYTE_LEVEL))
    assert text.count("Exchange") == 1 and "partial_count" in text
    assert "ReadSchema: struct<text:string>" in text


def test_statistics_combine_before_their_only_shuffle(spark, documents):
    text = plan(lengths.length_stats_per_file(lengths.token_lengths(documents)))
    assert text.count("Exchange") == 1 and "partial_percentile" in text


def test_sampling_ranks_are_limited_before_the_shuffle(spark, documents):
    text = plan(lengths.sample_per_file(documents, 5))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_routing_per_token_needs_no_shuffle(spark, sf_small):
    df = queries._logits(spark, sf_small)
    assert "Exchange" not in plan(routing.route_topk(df, 4, True))
    assert "partial_sum" in plan(routing.expert_load(df, 4))


def test_batch_ranks_have_no_global_sort_of_rows(spark, documents):
    text = plan(batches.epoch_batches(documents.select("doc_id"), 1, 1, 2, 2, 2))
    # The only single-partition exchange carries counts per hash prefix.
    single = re.findall(r"Exchange SinglePartition[^\n]*\n[^\n]*", text)
    assert len(single) == 1 and "HashAggregate" in single[0]


def test_no_query_uses_a_cross_join(spark, sf_small):
    for name in ("c1_render_chat", "a1_sample_per_file", "l5_epoch_batches", "r2_expert_load", "e7_dropped_symbols", "v1_merge_vocab", "a7_skip_bad_files", "c7_split_reasoning_ids"):
        text = plan(queries.QUERIES[name](spark, sf_small))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_chat_windows_stay_within_blocks(spark, sf_small):
    text = plan(chat.render_parts(queries.turns(spark, sf_small)))
    turn_windows = [line for line in text.split("\n") if re.search(r"Window \[.*lag\(_tool", line)]
    assert turn_windows and all("block" in line for line in turn_windows)
    assert "SortAggregate" not in text


def test_spread_leaves_enough_splits_alone(spark):
    wide = spark.range(0, 1000, 1, 16)
    assert spread(wide) is wide
    assert spread(wide.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_work_tables_are_dropped(spark, tmp_path):
    import os

    with WorkTables(spark) as work:
        df = work.write(spark.range(5), "numbers")
        path = work.paths[0]
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_filters_reach_the_scan_through_an_encoding(spark, documents, model, tmp_path):
    rows = codec.encode(documents, model)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan(rows.where("doc_id = 5"))
    documents.limit(20).write.partitionBy("lang").parquet(f"{tmp_path}/parts")
    parted = codec.encode(spark.read.parquet(f"{tmp_path}/parts"), model)
    pruned = re.search(r"PartitionFilters: \[[^\]]*lang[^\]]*= de", plan(parted.where("lang = 'de'")))
    assert pruned


def test_dropped_symbols_count_pieces_first(spark, documents, model):
    text = plan(codec.dropped_symbols(documents, model))
    assert re.search(r"HashAggregate\(keys=\[piece", text)
    symbols = text.index("keys=[symbol")
    assert symbols < text.index("keys=[piece")  # the plan is printed from the top


def test_file_totals_scan_the_texts_once(spark, documents, tmp_path):
    from glyphmill.sources import readers

    documents.select("text").write.parquet(f"{tmp_path}/t")
    text = plan(readers.good_file_totals(spark, f"{tmp_path}/t", [F.sum(F.length("text")).alias("n_chars")]))
    assert text.count("ReadSchema: struct<text:string>") == 1 and text.count("ReadSchema: struct<>") == 1


def test_only_small_tables_are_spread(spark, sf_small, monkeypatch):
    from glyphmill import session

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert "Exchange" in plan(spread(docs))
    monkeypatch.setattr(session, "SPREAD_BYTES", 1000)
    assert spread(docs) is docs


def test_no_folder_is_left_behind(spark, documents, tmp_path):
    import os

    from glyphmill import session
    from glyphmill.sources import readers

    folder = f"{session.work_dir(spark)}/glyphmill/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    documents.write.parquet(f"{tmp_path}/t")
    lengths.sample_per_file(documents, 5).count()
    for df in readers.read_good_files(spark, f"{tmp_path}/t"):
        df.count()
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def test_routing_computes_each_step_once(spark):
    """No step of the softmax is put into the lambda of the next one, nor into a filter before the rows are made."""
    df = spark.createDataFrame([(1, [1.0, 2.0, 2.0]), (2, []), (3, None)], "vec_id long, logits array<double>")
    for rows in (routing.route_topk(df, 2, True), routing.expert_load(df, 2)):
        done = rows._jdf.queryExecution().optimizedPlan().toString()
        assert done.count("array_max(") == 1 and done.count("EXP(") == 1 and done.count("sort_array(") == 1
    assert [(r.vec_id, r.slot, r.expert) for r in routing.route_topk(df, 2, True).orderBy("slot").collect()] == [(1, 0, 1), (1, 1, 2)]
    assert {r.expert for r in routing.expert_load(df, 2).collect()} == {0, 1, 2}
