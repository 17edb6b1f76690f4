"""Bounded micro-batches, restarts, bad input, and totals kept in a state store."""

import json
import os

import pytest

from glyphmill.model import BYTE_LEVEL
from glyphmill.operators.counts import piece_counts
from glyphmill.session import new_path
from glyphmill.streaming import corpus, state


def put(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("".join(line + "\n" for line in lines))


def pairs(df):
    return sorted((r.piece, r.n) for r in df.collect())


def test_folder_in_bounded_batches(spark, tmp_path):
    for k in range(30):
        put(f"{tmp_path}/in/{k}.txt", f"line {k}", "")
    query = corpus.start_append(corpus.stream_corpus(spark, f"{tmp_path}/in", max_files=7), f"{tmp_path}/out", f"{tmp_path}/mark")
    query.awaitTermination()
    assert [p["n_rows"] for p in corpus.progress(query)] == [14, 14, 14, 14, 4]
    assert all(p["n_bad"] == 0 for p in corpus.progress(query))
    put(f"{tmp_path}/in/30.txt", "late")
    query = corpus.start_append(corpus.stream_corpus(spark, f"{tmp_path}/in", max_bytes=1), f"{tmp_path}/out", f"{tmp_path}/mark")
    query.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(
        [f"line {k}" for k in range(30)] + [""] * 30 + ["late"])
    with pytest.raises(ValueError):
        corpus.stream_corpus(spark, f"{tmp_path}/in", max_files=1, max_bytes=1)


def test_bad_lines(spark, tmp_path):
    for k in range(4):
        put(f"{tmp_path}/in/{k}.jsonl", json.dumps({"text": f"t{k}"}), *(['{"text": "cu', "{}"] if k == 2 else []))
    stream = lambda policy: corpus.stream_corpus(spark, f"{tmp_path}/in", "jsonl", max_files=1, on_bad=policy)
    query = corpus.start_append(stream("skip"), f"{tmp_path}/skip", f"{tmp_path}/m1")
    query.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/skip").collect()) == ["t0", "t1", "t2", "t3"]
    assert sum(p["n_bad"] for p in corpus.progress(query)) == 2
    with pytest.raises(Exception):
        corpus.start_append(stream("strict"), f"{tmp_path}/strict", f"{tmp_path}/m2").awaitTermination()
    # After the file was mended the stream goes on, with every row once.
    put(f"{tmp_path}/in/2.jsonl", json.dumps({"text": "mended"}))
    corpus.start_append(stream("strict"), f"{tmp_path}/strict", f"{tmp_path}/m2").awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/strict").collect()) == ["mended", "t0", "t1", "t3"]


def test_state_over_batches_and_restart(spark, tmp_path, monkeypatch):
    root = new_path(spark, "state")
    lines = [f"common word{k % 7} only{k}" for k in range(24)]
    for k, line in enumerate(lines):
        put(f"{tmp_path}/in/{k:02d}.txt", line, "common")
    want = pairs(piece_counts(spark.createDataFrame([(x,) for x in lines] + [("common",)] * 24, "text string"), BYTE_LEVEL))

    def run():
        stream = corpus.stream_corpus(spark, f"{tmp_path}/in", max_files=3)
        state.start_piece_state(stream, BYTE_LEVEL, f"{root}/totals", f"{root}/mark").awaitTermination()

    whole, merged = state.upsert_totals, state._latest

    def dies_after(batch, k, path):
        whole(batch, k, path)
        if k == 3:
            raise RuntimeError("killed after its totals were written")

    def dies_between(batch, k, path):
        if k == 5:
            monkeypatch.setattr(state, "_latest", lambda *_: 1 / 0)
        whole(batch, k, path)

    assert state.piece_state(spark, f"{root}/totals").isEmpty()
    for broken in (dies_after, dies_between):
        monkeypatch.setattr(state, "upsert_totals", broken)
        with pytest.raises(Exception):
            run()
        monkeypatch.setattr(state, "_latest", merged)
    monkeypatch.setattr(state, "upsert_totals", whole)
    run()
    assert pairs(state.piece_state(spark, f"{root}/totals")) == want
    runs, held = state._runs(spark, f"{root}/totals")
    assert runs[0][0] == 0 and runs[-1][1] >= 7 and len(runs) <= 4 and len(held) <= 8
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


def test_folders_do_not_grow_with_batches(spark):
    path = new_path(spark, "totals")
    for k in range(20):
        state.upsert_totals(spark.createDataFrame([("a", k + 1), (f"b{k}", 1)], "piece string, n long").coalesce(1), k, path)
    assert pairs(state.piece_state(spark, path)) == sorted([("a", 20)] + [(f"b{k}", 1) for k in range(20)])
    runs, held = state._runs(spark, path)
    assert len(runs) + len(held) <= 10
