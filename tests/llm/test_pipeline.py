import collections

import corpus_pipeline
from glyphmill.llm import mixing
from glyphmill.llm.queries import op1_toxicity
from test_decontamination import brute as brute_hits
from test_simhash import brute as brute_components


def test_stages_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    kept, columns = {}, docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_small)
        if name != "sharding":
            assert after.columns == columns
        kept[name] = after.collect()
        before = spark.createDataFrame(kept[name], after.schema)
    toxic = {r.doc_id for r in op1_toxicity(spark, sf_small).where("predicted = 1").collect()}
    everything = {r.doc_id: r for r in docs.collect()}
    assert toxic and {r.doc_id for r in kept["toxicity"]} == set(everything) - toxic
    groups = brute_components([(r.doc_id, r.text) for r in kept["toxicity"]])
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted({c for _, c in groups.values()})
    items = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in kept["near_duplicates"]], items)
    after = {r.doc_id: r for r in kept["decontamination"]}
    for r in kept["near_duplicates"]:
        if not hits[r.doc_id][1]:
            assert after[r.doc_id] == r
    assert any(h[1] for h in hits.values())
    assert not any(h[1] for h in brute_hits([(r.doc_id, r.text) for r in after.values()], items).values())
    copies = collections.Counter(r.doc_id for r in kept["mixing"])
    want = {r.doc_id: r.epochs for r in mixing.mix(spark.createDataFrame(kept["decontamination"], docs.schema)).collect()}
    assert copies == {k: n for k, n in want.items() if n}
    assert collections.Counter(r.doc_id for r in kept["sharding"]) == copies
    assert {r.shard for r in kept["sharding"]} <= set(range(40))
    whole = corpus_pipeline.run(spark, sf_small).collect()
    assert sorted(map(str, whole)) == sorted(map(str, kept["sharding"]))


def test_empty_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
    assert docs.collect() == []
