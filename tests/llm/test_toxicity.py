import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import toxicity
from glyphmill.llm.queries import op1_toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op1_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hits >= 0.85 * sum(r.toxic for r in rows)
    assert hits >= 0.9 * sum(r.predicted for r in rows)


def rows_of(*docs):
    out = []
    for label, text in docs:
        t = toxicity.tokens_of([text])
        own = [toxicity.word_features(w) for w in t.vocabulary if w != "."]
        pairs = [(s, f) for c, s in zip(t.codes, t.sentence) for f in own[[w for w in t.vocabulary if w != "."].index(t.vocabulary[c])]]
        s, f = np.array(pairs, dtype="<i4").reshape(-1, 2).T
        out.append({"toxic": label, "weight": 1.0, "sentences": s.tobytes(), "features": f.tobytes(), "n": len(t.text_of)})
    return out


def test_noisy_or_finds_the_sentence():
    good = [(0, f"the cat number{k} sat. on a mat. all is well") for k in range(40)]
    bad = [(1, f"the cat number{k} sat. you vile thing. all is well") for k in range(40)]
    model = toxicity.fit(rows_of(*[(y, "".join(c for c in t if not c.isdigit())) for y, t in good + bad]))
    text = "On a mat. The cat sat.\nYou VILE thing! All is well"
    score = model.scores([text, "", "the cat sat"])
    assert score[0] > 0.5 > score[2] and score[1] == 0
    (found,) = model.offences(text)
    assert text[found["start"] : found["end"]] == "You VILE thing"
    one_by_one = 1 - np.prod([1 - model.scores([s])[0] for s in text.replace("\n", ".").replace("!", ".").split(".")])
    assert abs(one_by_one - score[0]) < 1e-9


def test_nulls_ties_and_clashes(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x" * 200_000), (3, "... ?")], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("c")).withColumn("_toxic", F.lit(0)).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "3", "None"] and all(0 <= r.score < 0.5 for r in got)
    empty = docs.limit(0)
    assert toxicity.score_documents(empty, toxicity.train(empty, labels.limit(0))).collect() == []
    assert toxicity.keep_clean(docs.drop("_toxic"), model).columns == docs.drop("_toxic").columns
