import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import lm
from glyphmill.llm.queries import op2_lm_scoring
from glyphmill.session import WorkTables


def words(text):
    return (text or "").encode().lower().split() + [b"\n"]


def test_query_base_and_gain(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()}
    held = {k for k in docs if zlib.crc32(str(k).encode()) % 7 == 2}
    counts = Counter(w for k, t in docs.items() if k not in held for w in words(t))
    n, v = sum(counts.values()), len(counts)
    rows = op2_lm_scoring(spark, sf_small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        own = words(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id in held, len(own), n)
        assert r.n_known == sum(w in counts for w in own)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert -math.inf < r.score < 0
    for out in (True, False):
        mine, base = (sum(getattr(r, c) for r in rows if r.held_out == out) for c in ("score", "base_score"))
        assert mine > base
    again = op2_lm_scoring(spark, sf_small).collect()
    assert all(math.isclose(a.score, b.score, rel_tol=1e-9) for a, b in zip(sorted(rows), sorted(again)))


TEXTS = ["the cat sat on the mat", "the dog sat", "", "The the the the cat"] * 5 + ["a b c d e f g h", "zebra"]


def hashes(*w):
    return lm._hashes([x.encode() for x in w])


def layout(parts, words=(), pairs=(), triples=(), common=()):
    return lm.Layout(parts, hashes(*common), hashes(*words), hashes(*pairs), hashes(*triples))


LAYOUTS = {
    "one part": layout(1),
    "several parts": layout(4, common=("the", "cat", "\n")),
    "hot words, pairs and triples": layout(3, words=("sat",), pairs=("cat", "the"), triples=("the", "the", "the", "the", "\r", "\r"), common=("the",)),
}


def fitted(spark, layout, sweeps=2):
    """State, and per part its dishes after the last sweep, the totals of its contexts and its mean probabilities."""
    rows = spark.createDataFrame([(k, True, t) for k, t in enumerate(TEXTS)], "row long, train boolean, text string").coalesce(1)
    with WorkTables(spark) as work:
        model = lm.fit(work, rows, layout, 5, sweeps, 1)
        try:
            tokens, kept = ([r.asDict() for r in df.collect()] for df in (model.tokens, model.kept(1)))
        finally:
            model.drop()
    out = []
    for number in sorted({r["part"] for r in tokens}):
        part = lm._part(pa.Table.from_pylist([r for r in tokens if r["part"] == number]), layout)
        own = [r for r in kept if r["part"] == number]
        mean = lm.averaged(part, model.state, own, 1)
        out.append((part, lm._history(part, own, sweeps)[sweeps], mean))
    return model.state, out


def test_what_parts_sent_is_given_back(spark):
    """Keys of contexts go once their totals are known; the kept sweeps and the totals of the last one stay."""
    rows = spark.createDataFrame([(k, True, t) for k, t in enumerate(TEXTS)], "row long, train boolean, text string").coalesce(1)
    with WorkTables(spark) as work:
        model = lm.fit(work, rows, LAYOUTS["several parts"], 5, 3, 1)
        try:
            before = [sorted(os.listdir(p)) for p in model.paths if os.path.exists(p)]
            kept = model.kept(1).collect()
            after = [os.listdir(p) for p in model.paths if os.path.exists(p)]
        finally:
            model.drop()
    sent = f"kind={lm.CONTEXTS}"
    assert [sent in names for names in before] == [False, False, True] and not any(sent in names for names in after)
    parts = {r.part for r in kept}
    assert {(r.sweep, r.part) for r in kept if r.kind == lm.TABLES} == {(k, p) for k in (1, 2, 3) for p in parts}
    assert {r.part for r in kept if r.kind == lm.TOTALS and r.sweep == 3} == parts


def test_words_before_a_word_are_packed_as_rising_codes(spark):
    """Half the bytes that the codes themselves would take, and the same words come back."""
    rng = np.random.default_rng(3)
    names = [f"w{k}" for k in range(1000)]
    text = " ".join(names[min(int(k), 999)] for k in rng.exponential(60, 100_000))
    own = layout(1, common=names)
    shared = type("Shared", (), {"value": own})
    batch = pa.RecordBatch.from_pydict({"row": pa.array([0]), "train": [True], "text": [text]})
    row = next(lm._packed(shared)(iter([batch]))).to_pylist()[0]
    assert len(row["v"]) < 0.6 * 100_000
    part = lm._part(pa.Table.from_pylist([row]), own)
    v = own.long(part.chunks[0]["v"], part.chunks[0]["vr"])
    w = np.repeat(np.frombuffer(row["w"], "<u8"), part.chunks[0]["n"])
    code = dict(zip(hashes(*names).tolist(), names)) | {int(lm.START_HASH): "\r", int(lm._hashes([lm.END])[0]): "\n"}
    mine = Counter((code[int(a)], code[int(b)]) for a, b in zip(v, w))
    assert mine == Counter(zip(["\r", *text.split()], [*text.split(), "\n"]))


def test_shuffles_hold_a_share_of_what_is_moved(spark, monkeypatch):
    """Parts and buckets are moved in turns, and what a turn has moved is given back before the next one."""
    seen = []
    monkeypatch.setattr(lm, "WAVE_PARTS", 1)
    drop_rows = WorkTables.drop_rows
    monkeypatch.setattr(WorkTables, "drop_rows", lambda self, path, folder: (seen.append((sorted(os.listdir(path)), folder)), drop_rows(self, path, folder)))
    rows = spark.createDataFrame([(k, True, t) for k, t in enumerate(TEXTS)], "row long, train boolean, text string").coalesce(1)
    with WorkTables(spark) as work:
        model = lm.fit(work, rows, LAYOUTS["several parts"], 5, 1, 1)
        try:
            parts = {r.part for r in model.tokens.collect()}
        finally:
            model.drop()
    packed = [(there, gone) for there, gone in seen if gone.startswith("wave=")]
    assert len(packed) == 4 and [len([n for n in there if n.startswith("wave=")]) for there, gone in packed if gone in there] == list(range(len(parts), 0, -1))
    assert [gone for _, gone in seen if gone.startswith(f"kind={lm.CONTEXTS}/")] == [f"kind={lm.CONTEXTS}/wave={k}" for k in range(4)]


def test_one_large_number_does_not_widen_the_others():
    counts = np.ones(100_000)
    counts[7] = 70_000
    packed = lm._ints(counts)
    assert len(packed) < len(counts) / 100 and np.array_equal(lm._floats(packed), counts)


@pytest.mark.parametrize("name", LAYOUTS)
def test_probabilities_add_up(spark, name):
    """At the root, and in every restaurant: dishes that it serves, and the others by its parent alone."""
    state, parts = fitted(spark, LAYOUTS[name])
    counts = Counter(w for t in TEXTS for w in words(t))
    assert (state.tokens, state.known) == (sum(counts.values()), len(counts))
    roots, seen, all_totals = {}, {}, {}
    for part, totals, _ in parts:
        p = part.probabilities(state, 2, totals)
        for customers, tables in zip([*part.customers, part.count], part.tables):
            assert np.all(tables <= customers) and np.all((tables >= 1) == (customers > 0))
        roots |= dict(zip(part.words.tolist(), p[0]))
        all_totals |= {c: (n, t) for c, n, t in zip(part.contexts.tolist(), *totals)}
        for level, of in ((1, part.word_of), (2, part.pair_of)):
            for context, own, parent, word in zip(part.contexts[part.context[level]].tolist(), p[level], p[level - 1][of], part.words[of if level == 1 else part.word_of[of]].tolist()):
                seen.setdefault((level, context), {})[word] = (own, parent)
    unknown = state.root(2, np.zeros(1), np.zeros(1))[0]
    assert math.isclose(sum(roots.values()) + unknown, 1, rel_tol=1e-9)
    for (level, context), dishes in seen.items():
        n, t = all_totals[context]
        left = (lm.STRENGTH + state.discount[level] * t) / (lm.STRENGTH + n)
        total = sum(p for p, _ in dishes.values()) + left * (1 - sum(q for _, q in dishes.values()))
        assert math.isclose(total, 1, rel_tol=1e-9)


def plain_sampler(texts, discount, sweeps, seed):
    """Customers moved one by one between tables; mean probability of each word after the two before it."""
    rng = random.Random(seed)
    tokens = []
    for t in texts:
        before = ["\r", "\r"]
        for w in words(t):
            tokens.append((w, before[1], before[0]))
            before = [before[1], w]
    known = len({t[0] for t in tokens})
    dishes, totals = {}, {}  # tables of a dish in a context, and customers and tables of a context

    def probability(context, w):
        if context is None:
            return 1 / (known + 1)
        own, (n, t) = dishes.get((context, w), []), totals.get(context, (0, 0))
        d = discount[len(context)]
        return (sum(own) - d * len(own) + (lm.STRENGTH + d * t) * probability(context[:-1] if context else None, w)) / (lm.STRENGTH + n)

    def add(context, w):
        if context is None:
            return
        own, (n, t), d, parent = dishes.setdefault((context, w), []), totals.get(context, (0, 0)), discount[len(context)], context[:-1] if context else None
        weights = [c - d for c in own] + [(lm.STRENGTH + d * t) * probability(parent, w)]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(1)
            add(parent, w)
        else:
            own[k] += 1
        totals[context] = (n + 1, t + (k == len(weights) - 1))

    def remove(context, w):
        if context is None:
            return
        own, (n, t) = dishes[context, w], totals[context]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        gone = own[k] == 0
        if gone:
            own.pop(k)
            remove(context[:-1] if context else None, w)
        totals[context] = (n - 1, t - gone)

    for w, v, u in tokens:
        add((v, u), w)
    mean = Counter()
    for k in range(sweeps):
        for w, v, u in tokens:
            remove((v, u), w)
            add((v, u), w)
        if k >= sweeps // 4:
            for t in set(tokens):
                mean[t] += probability((t[1], t[2]), t[0]) / (sweeps - sweeps // 4)
    return tokens, mean


def test_agrees_with_a_plain_sampler(spark):
    state, parts = fitted(spark, LAYOUTS["hot words, pairs and triples"], sweeps=6)
    mine = {}
    for part, _, mean in parts:
        for chunk in part.chunks:
            w = np.repeat(np.frombuffer(chunk["w"], "<u8"), np.frombuffer(chunk["n"], "<u4"))
            at = len(mine.setdefault("used", {}).get(part.number, []))
            mine["used"].setdefault(part.number, []).extend(w)
            v, u = (part.layout.long(chunk[c], chunk[c + "r"]) for c in "vu")
            mine |= {(int(a), int(b), int(c)): p for a, b, c, p in zip(w, v, u, mean[part.triple[at : at + len(w)]])}
    tokens, mean = plain_sampler(TEXTS, state.discount, 400, 3)
    code = lambda x: int(lm._hashes([x if isinstance(x, bytes) else x.encode()])[0])
    gap = [math.log10(mine[code(w), code(v), code(u)]) - math.log10(mean[w, v, u]) for w, v, u in tokens]
    assert abs(sum(gap) / len(gap)) < 0.02 and max(map(abs, gap)) < 0.2


def test_seating_follows_the_restaurant_process():
    """One dish that the parent always draws: tables as in a plain two-parameter restaurant."""
    rng, d, n = np.random.default_rng(1), 0.5, 15
    got = lm.seat(np.full(20000, n), np.zeros(20000), np.ones(20000), d, rng).mean()
    want = 1.0
    for i in range(1, n):
        want += (lm.STRENGTH + d * want) / (lm.STRENGTH + i)
    assert abs(got - want) < 0.03
    large = lm.seat(np.array([10**9]), np.zeros(1), np.ones(1), d, rng)[0]
    assert 1e4 < large < 1e6


def test_nulls_ties_and_clashes(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "a b c " * 30_000), (4, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("c")).withColumn("score", F.lit(0)).coalesce(1)
    got = lm.score_documents(docs, F.col("doc_id") != 4, part_bytes=20_000).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.held_out) for r in got) == sorted((str(i), len(words(t)), i == 4) for i, t in rows)
    assert {r.n_known for r in got if r.doc_id == 4} == {1}
    none = lm.score_documents(docs, F.lit(False)).collect()
    assert len(none) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 and r.score <= 0 for r in none)
    assert lm.score_documents(docs.limit(0), F.lit(True)).collect() == []


def stirling_weights(n, others, p, d):
    """Probability of each number of tables of n customers, from the recursion over customers."""
    s = [1.0]
    for i in range(1, n):
        s = [(s[t] * (i - d * (t + 1)) if t < i else 0) + (s[t - 1] if t else 0) for t in range(i + 1)]
    w = [x * math.prod(p * (lm.STRENGTH + d * (others + k)) for k in range(t + 1)) for t, x in enumerate(s)]
    return np.array(w) / sum(w)


@pytest.mark.parametrize("n,others,p,d", [(5, 3, 0.2, 0.5), (10, 1000, 0.001, 0.75), (50, 1000, 0.001, 0.75), (50, 1000, 0.01, 0.75), (40, 10**6, 0.05, 0.9)])
def test_tables_follow_their_conditional_distribution(n, others, p, d):
    rng = np.random.default_rng(2)
    want = stirling_weights(n, others, p, d)
    got = lm.seat(np.full(20000, n), np.full(20000, float(others)), np.full(20000, p), d, rng)
    assert np.abs(np.bincount(got.astype(int), minlength=n + 1)[1:] / 20000 - want).max() < 0.015
    if n < 40:  # the integral is for many customers
        return
    large = lm._seat_large(np.full(4000, n), np.full(4000, float(others)), np.full(4000, p), d, rng)
    assert np.abs(np.bincount(large.astype(int), minlength=n + 1)[1:] / 4000 - want).max() < 0.03


@pytest.mark.parametrize("others,p,d", [(0, 1.0, 0.5), (3, 0.95, 0.75), (200, 0.3, 0.6), (10**5, 1e-4, 0.75), (10**5, 0.02, 0.8)])
def test_table_and_integral_agree(others, p, d):
    """Just below the size where the integral takes over, both draw from one distribution."""
    rng, n = np.random.default_rng(4), 1000
    args = np.full(4000, n), np.full(4000, float(others)), np.full(4000, p), d, rng
    a, b = np.sort(lm.seat(*args)), np.sort(lm._seat_large(*args))
    grid = np.unique(a)
    gap = np.abs(np.searchsorted(a, grid, side="right") - np.searchsorted(b, grid, side="right")) / 4000
    assert gap.max() < 0.045 and abs(a.mean() - b.mean()) < 0.05 * max(1.0, a.std())


def test_keys_and_numbers_come_back():
    rng = np.random.default_rng(6)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True))
        assert np.array_equal(lm._keys_of(lm._keys(keys)), keys)
    for x in ([], [0, 255], [0, 256], [70000], [2**40]):
        assert lm._floats(lm._ints(np.array(x, dtype=float))).tolist() == x
