"""One query per operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphmill.llm import bpe, decontamination, divergence, extraction, lm, mixing, quality, secrets, sharding, simhash, substrings, toxicity, whitening
from glyphmill.llm.common import crc_mod, table


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learn from the rows that are not held out."""
    return toxicity.train(docs.where(crc_mod(F.col("doc_id"), 5) != 0), labels)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score_documents(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "offences",
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), keep=False).drop("kept")


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.extract(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "importance")


def _only(kind: int) -> Callable[[Column], Column]:
    return lambda k: F.when(k == kind, k)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    n = [F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    digest = F.sha2(F.encode(secrets.written_spans(F.col("base")), "UTF-8"), 256)
    return found.select("doc_id", *n, digest.alias("base_sha256"), secrets.written_spans(F.col("spans")).alias("spans"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.Vocabulary(bpe.read_ranks(ranks), public_tokenizers.PATTERN))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_substrings": op8_substrings,
    "op9_extraction": op9_extraction,
    "op10_secrets": op10_secrets,
    "op11_divergence": op11_divergence,
    "op12_bpe": op12_bpe,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op7_quality": quality.ORACLE,
    "op11_divergence": divergence.ORACLE,
}
