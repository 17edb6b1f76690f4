import hashlib
import re

from pyspark.sql import functions as F

from glyphmill.llm import decontamination as d
from glyphmill.llm.queries import op3_decontamination


def brute(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for name, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(name)
    sizes = sorted({len(k) for k in windows})
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (key := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[key]
        names = ",".join(sorted(map(str, found)))
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


ITEMS = [(1, "a b c d e f g h i j k l m"), (2, "x Y z"), (3, "b c d e f g h i j k b"), (4, ""), (5, None), (6, "z x"), (7, "Été! q,q. r s t u v w x y z a")]
DOCS = [
    (1, "0 A b c-d e f g h i j 1 x y z x"), (2, None), (3, ""), (4, "a b c d e f g h i"), (5, "x y x y z"),
    (6, "b c d e f g h i j k b c d e f g h i j k l"), (7, "ÉTÉ q q r s t u v w x y z a"), (8, "été q q r s t u v w x y z a"), (8, "été q q r s t u v w x y z a"),
    (None, "z x" * 3000),
]


def found_rows(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("_row", F.lit(1))
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(5))
    found = d.find_contamination(docs, items, **options)
    return [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in found.collect()]


def test_equals_brute_force(spark):
    got, want = found_rows(spark, DOCS, ITEMS), brute(DOCS, ITEMS)
    assert len(got) == len(DOCS)
    for r in got:
        assert r[1:] == want[r[0]], r


def test_blocks_of_items_give_the_same(spark):
    assert sorted(found_rows(spark, DOCS, ITEMS, block_words=5), key=str) == sorted(found_rows(spark, DOCS, ITEMS), key=str)


def test_empty_tables(spark):
    assert found_rows(spark, [], ITEMS) == []
    assert {r[2] for r in found_rows(spark, DOCS, [])} == {0}


def test_query_equals_brute_force(spark, sf_small):
    rows = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf_small}/{t}.parquet").selectExpr("doc_id" if t == "documents" else "item_id", "text").collect()]
    want = brute(rows("documents"), rows("benchmark"))
    got = {r.doc_id: tuple(r)[1:] for r in op3_decontamination(spark, sf_small).collect()}
    assert got == want
    assert any(v[-1] for v in got.values())


def test_spans_are_cut_until_nothing_is_found(spark):
    text = "keep one, a b c d e f g h i j k and two " + "word " * 30
    nested = "a b c d e " + "a b c d e f g h i j k " + "f g h i j k " + "w " * 60
    docs = spark.createDataFrame([(1, text), (2, "a b c d e f g h i j"), (3, None), (4, nested)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = {r.doc_id: r.text for r in d.decontaminate(docs, items).collect()}
    assert set(got) == {1, 3, 4} and got[3] is None
    assert got[1] == text.replace("a b c d e f g h i j k", "\n")
    assert not d.ItemAutomaton([("1", ITEMS[0][1].encode())]).scan(d.words_of(got[4].encode()))[0].any()


def test_cuts_do_not_depend_on_blocks(spark):
    """Coverage is taken over all blocks' hits, and a cut for one block can join a window of another."""
    one, two = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(30)]
    items = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, "x Y z")], "item_id long, text string")
    covered = " ".join(one + two + ["w"] * 30)
    joined = " ".join(one[:5] + two + one[5:10] + ["w"] * 60)
    texts = [covered, joined, None, "", " ".join(one[:9]), "keep x y z " + "w " * 9, " ".join(two[:12] + ["w"] * 11)]
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").withColumn("a.b", F.lit("c"))

    def cleaned(**options):
        found = d.decontaminate(docs, items, **options)
        assert found.columns == docs.columns
        return sorted((tuple(r) for r in found.collect()), key=str)

    whole = cleaned()
    assert cleaned(block_words=40) == cleaned(block_words=3) == whole
    assert [r[0] for r in whole] == [1, 2, 3, 4, 5] and whole[0][1].split() == ["w"] * 60
    assert cleaned(min_words=15, block_words=40) == cleaned(min_words=15)
