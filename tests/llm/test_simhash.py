import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import simhash
from glyphmill.llm.components import components
from glyphmill.llm.queries import op6_simhash
from glyphmill.session import WorkTables


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows):
    """Components over all pairs of distinct fingerprints."""
    prints = {i: plain_fingerprint(t) for i, t in rows}
    distinct = np.array(sorted(set(prints.values())), dtype=np.uint64)
    label = list(range(len(distinct)))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(distinct ^ x) <= 4) for x in distinct]
    while changed:
        changed = False
        for k, own in enumerate(near):
            low = min(label[j] for j in own)
            if low < label[k]:
                label[k], changed = low, True
    of = {int(fp): lab for fp, lab in zip(distinct, label)}
    least = {}
    for i in sorted(prints):
        least.setdefault(of[prints[i]], i)
    return {i: (f"{fp:016x}", least[of[fp]]) for i, fp in prints.items()}


def test_query_equals_brute_force(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash(spark, sf_small).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_links_of_random_near_fingerprints(spark, monkeypatch):
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    values = np.array(sorted(prints), dtype=np.uint64)
    linked = {(min(i, j), max(i, j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4).tolist() if i != j}
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")

    def labels(edges):
        own = {int(v): int(v) for v in values.view(np.int64)}
        while True:
            old = dict(own)
            for a, b in edges:
                own[a] = own[b] = min(own[a], own[b])
            if own == old:
                return own

    signed = values.view(np.int64).tolist()
    want = labels([(signed[i], signed[j]) for i, j in linked])
    found = [tuple(r) for r in simhash.near_links(frame).collect()]
    assert labels(found) == want
    with WorkTables(spark) as work:
        got = {r.a: r.b for r in components(spark.createDataFrame(found, "a long, b long"), work).collect()}
    assert {v: got.get(v, v) for v in signed} == want


def test_large_groups_are_cut_further(monkeypatch):
    rng = random.Random(5)
    base = rng.getrandbits(64) & ~simhash._mask(range(13, 64))
    group = np.array([base | rng.getrandbits(12) << 30 | rng.getrandbits(9) << 40 for _ in range(400)], dtype=np.uint64)
    whole = simhash.group_links(group, 0)
    monkeypatch.setattr(simhash, "GROUP", 50)
    cut = simhash.group_links(group, 0)
    # Cutting may leave out links whose chain starts elsewhere, never one whose chain starts here.
    for a, b in whole:
        assert bin(a ^ b).count("1") <= 4
    here = simhash._chained(np.repeat(group, len(group)), np.tile(group, len(group)), np.zeros(len(group) ** 2, dtype=int))
    label = {int(g): int(g) for g in group}
    for _ in range(60):
        for a, b in cut:
            label[a] = label[b] = min(label[a], label[b])
    for k in np.flatnonzero(here):
        assert label[int(group[k // len(group)])] == label[int(group[k % len(group)])]


def test_nulls_ties_and_clashes(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (1, "one two"), (1, "one two"), (None, "One  two"), (7, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("row", F.lit(1)).withColumn("component_id", F.lit(0))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.with_components(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (4, 3), (1, 1), (1, 1), (None, 1), (7, 7)], key=str)
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 7]


@pytest.mark.parametrize("column", ["doc_id long, text string"])
def test_empty_table(spark, column):
    docs = spark.createDataFrame([], column)
    assert simhash.with_components(docs).collect() == [] and simhash.one_per_component(docs).collect() == []


def test_one_row_of_each_component_from_shuffled_input(spark):
    rows = [(k % 30 if k % 7 else None, f"text number {k % 25} of some words that differ {'x' * (k % 25)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS doc", "3 AS fp", "4 AS _row").repartition(7)
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    members = {}
    for k, (_, group) in brute(list(enumerate(t for _, t in rows))).items():
        members.setdefault(group, []).append(rows[k])
    assert len(found) == len(members) > 1
    for own in members.values():
        ids = [i for i, _ in own if i is not None]
        mine = [f for f in found if f in own]
        assert mine and (mine[0][0] == min(ids) if ids else mine[0][0] is None)
