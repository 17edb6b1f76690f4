import collections
import math

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import mixing, sharding
from glyphmill.llm.queries import op4_mixing, op5_sharding


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """Reshare by weight, one round after another."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: most * sizes[s] for s in capped}
        capped |= over


def test_targets_and_taken(spark, sf_small):
    for r in [op4_mixing(spark, sf_small)]:
        rows = r.join(spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
    want = targets(sizes)
    for r in rows:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(op4_mixing(spark, sf_small).collect()) == sorted(op4_mixing(spark, sf_small).collect())


def test_mixing_edge_cases(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (None, None, "x"), (2, "", "x"), (3, "a", "é"), (4, "w " * 50_000, "b"), (5, "q r", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("c")).withColumn("target", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {None: 6, "x": 0, "é": 1, "b": 50_002}
    want = targets(sizes)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
    assert mixing.mix(docs.limit(0)).collect() == []


def test_rows_decide_for_themselves(spark):
    """One id in two sources, null and repeated ids, copies, and columns that look like the operator's own."""
    rows = [(k % 150, f"text {k} " + "w " * (k % 23), "ab"[k % 2]) for k in range(600)]
    rows += [(None, f"null {k} " + "v " * (k % 11), "c") for k in range(200)] + [(7, "same text here", "d")] * 40 + [(None, None, None), (8, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(["place", "source_size", "limit", "times", "_epochs", "_copy", "doc", "of"])])
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    words = lambda t: len((t or "").split())
    sizes, taken, copies = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    for r in got.collect():
        taken[r.source] += words(r.text)
        copies[r.doc_id, r.text, r.source] += 1
    want = targets(sizes)
    for s in "abc":
        assert abs(taken[s] - want[s]) <= max(words(t) for _, t, own in rows if own == s) / 2 + 1e-6
    there = collections.Counter(rows)
    assert all(n % there[k] == 0 and n <= 3 * there[k] for k, n in copies.items())
    assert abs(taken["d"] - want["d"]) <= sizes["d"] / 2
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mixed_rows(docs).collect()))
    assert mixing.mixed_rows(docs.limit(0)).collect() == []


def test_rows_equal_the_mix(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "source")
    want = {r.doc_id: r.epochs for r in mixing.mix(docs).collect() if r.epochs}
    assert collections.Counter(r.doc_id for r in mixing.mixed_rows(docs).collect()) == want


def test_shards_are_even_and_slots_gapless(spark):
    rows = op5_sharding(spark, "/root/testdata/sf0.01").collect()
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= max(r.size for r in rows)
    assert len({(r.shard, r.virtual_slot) for r in rows}) == len({r.virtual_slot for r in rows})


def test_rebalancing_moves_little(spark, tmp_path):
    loads = {k: 50 + k * 37 % 101 for k in range(4096)}
    first = sharding.first_map(loads, 10, 4096)
    more = sharding.rebalanced_map(first, loads, 11)
    moved = sum(loads[k] for k in loads if first[k] != more[k])
    total = collections.Counter()
    for k, s in more.items():
        total[s] += loads[k]
    mean = sum(loads.values()) / 11
    assert moved <= 1.1 * mean and max(total.values()) <= 1.02 * mean and set(total) == set(range(11))
    fewer = sharding.rebalanced_map(more, loads, 7)
    assert set(fewer.values()) == set(range(7))
    sharding.save_map(spark, str(tmp_path), 1, first)
    sharding.save_map(spark, str(tmp_path), 2, more)
    assert sharding.load_map(spark, str(tmp_path), 1) == first and sharding.load_map(spark, str(tmp_path), 2) == more


def test_the_map_is_stored_and_edited(spark, tmp_path):
    """Sizes, checksums, slots and the greedy map against plain Python; a second run edits the stored version."""
    import zlib

    import xxhash

    folder = f"{tmp_path}/map"
    rows = [(k if k % 9 else None, "é word " * (k * 37 % 211) + str(k)) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs, 7, 256, map_path=folder).collect()
    assert sharding.latest_version(spark, folder) == 1
    size = lambda t: len(t.encode()) + 16
    slot = lambda i, t: xxhash.xxh64_intdigest((t if i is None else str(i)).encode(), seed=42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    loads = collections.Counter()
    for i, t in rows:
        loads[signed(slot(i, t)) % 256] += size(t)
    placed, held = {}, [0] * 7
    for k in sorted(range(256), key=lambda k: (-loads[k], k)):
        placed[k] = min(range(7), key=lambda s: (held[s], s))
        held[placed[k]] += max(1, loads[k])
    want = sorted((str(i), size(t), zlib.crc32(t.encode()), signed(slot(i, t)) % 256, placed[signed(slot(i, t)) % 256]) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.virtual_slot, r.shard) for r in got) == want
    assert sharding.load_map(spark, folder, 1) == placed
    # More rows and one more shard: version 2, in which few slots have moved.
    more = docs.union(spark.createDataFrame([(k, "new " * 50) for k in range(1000, 1200)], docs.schema))
    again = {r.doc_id: r.shard for r in sharding.sharded_rows(more, 8, 256, map_path=folder).collect()}
    edited = sharding.load_map(spark, folder, 2)
    assert sharding.latest_version(spark, folder) == 2 and set(edited.values()) == set(range(8))
    assert sum(edited[k] != placed[k] for k in placed) < 256 / 3
    assert all(again[r.doc_id] == edited[r.virtual_slot] for r in got if r.doc_id is not None)
    # Nothing to move: no new version.  A version that was not finished does not count.
    sharding.sharded_rows(more, 8, 256, map_path=folder)
    assert sharding.latest_version(spark, folder) in (2, 3)
    (tmp_path / "map" / "version=00000009").mkdir()
    assert sharding.latest_version(spark, folder) in (2, 3)
    with pytest.raises(ValueError):
        sharding.sharded_rows(more, 8, 128, map_path=folder)


def test_sharding_edge_cases(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "é" * 90_000)], "doc_id long, text string").withColumn("shard", F.lit("c")).withColumn("size", F.lit(0))
    got = sorted((str(r.doc_id), r.size, r.text_crc32) for r in sharding.shard_documents(docs).collect())
    assert [g[:2] for g in got] == [("1", 16), ("1", 16), ("2", 180_016), ("None", 16)] and got[0][2] == 0
    assert sharding.shard_documents(docs.limit(0)).collect() == []
