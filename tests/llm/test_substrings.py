import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import substrings
from glyphmill.llm.anchors import WINDOW, anchor_runs
from glyphmill.llm.queries import op8_substrings


def brute(texts):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + WINDOW] for t in texts for i in range(len(t) - WINDOW + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - WINDOW + 1):
            if seen[t[i : i + WINDOW]] > 1:
                gone[i : i + WINDOW] = b"\1" * WINDOW
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    texts = [None, "", "a" * 199, "ab" * 99 + "x", "é" * 450, "z" * 700, "abc" * 300]
    for k in range(60):
        t = prose(rng.randint(5, 200))
        if k % 3:
            at = rng.randint(0, len(t))
            p = shared[k % 4]
            a = rng.randint(0, 40)
            t = t[:at] + p[a : len(p) - rng.randint(0, 60)] + t[at:]
        texts.append(t)
    texts += [texts[10], texts[11] + "!", "?" + texts[11], texts[12][:-1]]
    return texts


@pytest.mark.parametrize("batches,many", [(2, 4096), (5, 4096), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, batches, many):
    monkeypatch.setattr(substrings, "MANY", many)
    texts = made_texts(batches)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("row", F.lit("c")).withColumn("spans", F.lit(0))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs, batches=batches).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_query_equals_brute_force(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_substrings(spark, sf_small).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 500)
    text = " ".join(made_texts(3)[8:30]).encode()
    windows = []
    for ids, offsets, own in substrings._pieces([7], [text]):
        r = anchor_runs(own)
        windows += [offsets[t] + s + k for t, s, n in zip(r.text, r.start, r.windows) for k in range(n)]
    assert sorted(windows) == list(range(len(text) - WINDOW + 1))


def test_ties_and_empty(spark):
    long = " ".join(made_texts(4)[8:20])
    docs = spark.createDataFrame([(None, long), (1, long), (1, long)], "doc_id long, text string")
    assert {(r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(docs).collect()} == {(len(long.encode()), 1, b"")}
    assert substrings.remove_repeats(docs.limit(0)).collect() == []


def test_query_merges_levels_and_reads_the_text_once(spark, sf_small, monkeypatch):
    merged, passes = [], []
    add, batches = substrings.SuffixIndex.add, substrings.suffix_batches
    monkeypatch.setattr(substrings.SuffixIndex, "add", lambda index, *own: (add(index, *own), merged.append([n for n, *_ in index.levels])))
    monkeypatch.setattr(substrings, "suffix_batches", lambda *a: passes.append(a[2]) or batches(*a))
    op8_substrings(spark, sf_small)
    assert passes == [substrings.BATCHES] and merged == [[1], [1, 1], [2, 1], [2, 1, 1]]


@pytest.mark.parametrize("frequent", [2, 3, 10**9])
def test_frequent_kinds_apart(spark, monkeypatch, frequent):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    texts = made_texts(6) * 2 + made_texts(6)[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_batches_follow_from_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([("é" * 100,), (None,)], "text string")
    assert substrings.batches_for(docs) == 4 and substrings.batches_for(docs.limit(0)) == 4
    monkeypatch.setattr(substrings, "BATCH_BYTES", 30)
    assert substrings.batches_for(docs) == 7
