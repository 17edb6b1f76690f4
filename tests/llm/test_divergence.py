import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphmill.llm import divergence
from glyphmill.llm.divergence import Matrix, Quadtree, audit, pair_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs=3, top=200):
    """Every share of every group and term, one by one."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(own)
        docs[lang].update(set(own))
    out = []
    for lang in {g[0] for g in groups}:
        terms = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        sources = sorted((s for l, s in groups if l == lang), key=str.encode)
        total = {t: sum(counts[lang, s][t] for s in sources) for t in terms}

        def shares(n):
            return {t: 1 + 10**9 * (n[t] + 1) // (sum(n[x] for x in terms) + len(terms)) for t in terms}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(total)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in terms), o) for o in sources if o != s]
            raised = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in terms if counts[lang, s][t] and p[s][t] > q[t]]
            for part, own in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(raised, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(own, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "lang string, source string, text string, row int, p string")


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, groups, n):
    rng = np.random.default_rng(seed)
    words = ["Äpfel", "naïve", "the", "The", "x1y", "don't", "日本", "Z", *(f"w{chr(97 + k)}{chr(97 + k % 5)}" for k in range(26))]
    return [(f"l{k % 2}", f"s{rng.integers(groups)}", " ".join(rng.choice(words, rng.integers(0, 12)))) for k in range(n)]


def test_equals_brute_force(spark):
    rows = corpus(1, 4, 150)
    assert found(audit(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("band,columns", [(2, 4), (3, 1), (64, 8192)])
def test_bands_and_blocks_give_the_same_pairs(spark, band, columns):
    rows = corpus(2, 7, 200)
    pairs = pair_divergence(Matrix(frame(spark, rows), band=band, columns=columns)).collect()
    expected = {(l, s, i): v for l, s, part, i, v, _ in brute(rows) if part == "pair"}
    assert {(r.lang, r.source, r.other): r.value for r in pairs} == expected and len(pairs) == len(expected)


def test_nulls_empty_texts_ties_and_languages_without_terms(spark):
    rows = [(None, None, "same same"), ("", "a", "same"), (None, "b", "SAME other"), (None, None, None), ("", "c", ""), ("en", "a", "once"), ("en", "b", None)]
    rows += [("de", s, "gleich auch gleich") for s in "abc"] + [("fr", "only", "un un")] * 3 + [("de", "a", "wort " * 5000)]
    assert found(audit(frame(spark, rows))) == brute(rows)
    assert audit(frame(spark, [])).count() == 0


def test_top_terms_and_document_threshold(spark):
    rows = corpus(3, 3, 60)
    assert found(audit(frame(spark, rows), min_docs=1, top_terms=3)) == brute(rows, 1, 3)


def test_the_tree_ends_at_empty_quadrants():
    rng = np.random.default_rng(4)
    cells = rng.random((13, 50)) < 0.05
    r, c = np.nonzero(cells)
    tree = Quadtree(r, c, *cells.shape)
    for row in range(13):
        others = np.array([k for k in range(13) if k != row])
        at, column = tree.leaves(row, others)
        assert set(zip(at.tolist(), column.tolist())) == {(k, x) for k, o in enumerate(others) for x in np.flatnonzero(cells[row] | cells[o])}
    empty = Quadtree(np.zeros(0, int), np.zeros(0, int), 3, 0)
    assert [len(x) for x in empty.leaves(0, np.array([1, 2]))] == [0, 0]


def test_shares_of_counts_beyond_64_bits(spark):
    big = 5 * 10**12
    row = spark.sql(f"SELECT {big}L AS n, {3 * big}L AS total, 7L AS terms")
    assert row.select(divergence.share(row.n, row.total, row.terms)).first()[0] == 1 + 10**9 * (big + 1) // (3 * big + 7)
