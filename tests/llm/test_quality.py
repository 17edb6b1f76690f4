from itertools import permutations

from pyspark.sql import functions as F

from glyphmill.llm import quality


def repeats(text):
    w = (text or "").split()
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)})


TEXTS = [
    None, "", " \n\t ", "a b c a b c a", "x x x x", "one two three four", "a\n\n a\na\na b\n", "WHY!! " * 60, "word " * 60, " ".join(f"w{k}" for k in range(60)),
    " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70)), "é" * 100_000, " ".join(f"tok{chr(97 + k % 26)}{chr(97 + k // 26)} ###" for k in range(70)),
]


def frame(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[10]), (10, TEXTS[10])], "doc_id long, text string")
    return docs.withColumn("n_words", F.lit("x")).withColumn("w", F.lit(1))


def test_counts_equal_plain_python(spark):
    for r in quality.measured(frame(spark)).where("doc_id is not null").collect():
        t = TEXTS[r.doc_id] or ""
        lines = [x for x in t.split("\n") if x.split()]
        assert r.n_repeat_words == repeats(t)
        assert r.n_words == len(t.split()) and r.word_chars == sum(map(len, t.split()))
        assert r.n_symbols == sum(c in quality.SYMBOLS for c in t)
        assert r.n_dup_lines == len(lines) - len(set(lines))


def test_verdicts_do_not_depend_on_the_order(spark):
    orders = list(permutations(quality.RULES))
    want = None
    for order in (list(quality.RULES), list(orders[100]), list(orders[-1]), None):
        rows = quality.judge(frame(spark), order).collect()
        got = sorted((str(r.doc_id), r.kept, r.base_failed) for r in rows)
        assert want is None or got == want
        want = got
    assert [r for r in want if r[1]] == [("10", True, False), ("10", True, False), ("None", True, False)]
    assert {r.rejected_by for r in rows} >= {None, "base"}


def test_cascade_prefers_rejection_per_cost(spark):
    docs = spark.createDataFrame([(k, TEXTS[12]) for k in range(40)] + [(k, TEXTS[10]) for k in range(40)], "doc_id long, text string")
    rules = {"never": lambda: F.col("n_words") < 0, "half": lambda: 10 * F.col("n_symbols") > F.col("n_words")}
    assert quality.cascade_order(docs, rules) == ["half", "never"]


def test_empty_and_native(spark):
    empty = frame(spark).limit(0)
    assert quality.judge(empty).collect() == []
    plan = quality.judge(frame(spark), list(quality.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
