"""Vocabulary tables: building, extending, listing, saving.

Every table here holds at most one row per vocabulary entry, which the symbol space bounds,
so ordering one by a window is a fixed-size job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glyphmill.functions.pieces import SPACE_MARK, VISIBLE, split_special
from glyphmill.model import (
    ADDED_SCHEMA,
    MERGES_SCHEMA,
    VOCAB_SCHEMA,
    BpeModel,
    Profile,
    small_table,
)

_BYTE_OF = {c: b for b, c in enumerate(VISIBLE)}
UNK = "<unk>"


def hex_of_visible(token: str) -> str:
    return bytes(_BYTE_OF[c] for c in token).hex().upper()


def _hex_of_text(token: str) -> str:
    return token.replace(SPACE_MARK, " ").encode().hex().upper()


def model_tables(spark: SparkSession, state, profile: Profile, alphabet: Sequence[str]) -> BpeModel:
    """Byte-level layout: specials, alphabet, merges."""
    specials, letters = set(profile.specials), set(alphabet)
    vocab = []
    for i, token in enumerate(state.tokens):
        kind = "special" if token in specials else "byte" if token in letters else "merge"
        vocab.append((token, i, kind, None, _hex_of_text(token) if kind == "special" else hex_of_visible(token)))
    merges = [(r, state.text(p[0]), state.text(p[1]), state.text(m)) for r, (p, m) in enumerate(state.merges)]
    added = [(state.ids[s], s, True) for s in profile.specials]
    return BpeModel(
        small_table(spark, vocab, VOCAB_SCHEMA),
        small_table(spark, merges, MERGES_SCHEMA),
        small_table(spark, added, ADDED_SCHEMA),
        profile,
    )


def char_model_tables(spark: SparkSession, state, profile: Profile, chars: Sequence[str]) -> BpeModel:
    """Character layout: unknown, user symbols, byte tokens, merges by score, characters."""
    vocab = [(UNK, 0, "unknown", 0.0, "")]
    vocab += [(s, 1 + i, "user", 0.0, _hex_of_text(s)) for i, s in enumerate(profile.specials)]
    first = len(vocab)
    vocab += [(f"<0x{b:02X}>", first + b, "byte", 0.0, f"{b:02X}") for b in range(256)]
    first = len(vocab)
    learned = state.tokens[len(chars):]
    for i, token in enumerate([*learned, *chars]):
        kind = "merge" if i < len(learned) else "char"
        vocab.append((token, first + i, kind, -float(i), _hex_of_text(token)))
    merges = [(r, state.text(p[0]), state.text(p[1]), state.text(m)) for r, (p, m) in enumerate(state.merges)]
    added = [(1 + i, s, True) for i, s in enumerate(profile.specials)]
    return BpeModel(
        small_table(spark, vocab, VOCAB_SCHEMA),
        small_table(spark, merges, MERGES_SCHEMA),
        small_table(spark, added, ADDED_SCHEMA),
        profile,
    )


def vocab_table(model: BpeModel) -> DataFrame:
    return model.vocab.select("token_id", "token", "kind", "score", "token_hex")


def merge_vocab(base: DataFrame, other: DataFrame) -> DataFrame:
    """Base order kept; tokens only in ``other`` follow in its order with score 0, first one wins."""
    size = base.agg((F.coalesce(F.max("token_id"), F.lit(-1)) + 1).alias("size"))
    fresh = (
        other.join(base, "token", "left_anti")
        .groupBy("token")
        .agg(F.min("token_id").alias("seen_at"), F.min_by("token_hex", "token_id").alias("token_hex"))
    )
    offset = size.first()["size"]
    appended = fresh.select(
        "token",
        (F.row_number().over(Window.orderBy("seen_at")) - 1 + offset).cast("int").alias("token_id"),
        F.lit("appended").alias("kind"),
        F.lit(0.0).alias("score"),
        "token_hex",
    )
    return base.unionByName(appended)


def expand_vocab(base: DataFrame, pieces: Sequence[str]) -> DataFrame:
    rows = [(p, i, "appended", 0.0, _hex_of_text(p)) for i, p in enumerate(pieces)]
    return merge_vocab(base, small_table(base.sparkSession, rows, VOCAB_SCHEMA))


def add_tokens(model: BpeModel, contents: Sequence[str]) -> BpeModel:
    """Non-special added tokens: next ids, matched whole before anything else.

    A text already in the vocabulary keeps its id and is only registered for matching.
    """
    spark = model.spark
    rows = [(p, i, "added", None, _hex_of_text(p)) for i, p in enumerate(contents)]
    asked = small_table(spark, rows, VOCAB_SCHEMA)
    vocab = merge_vocab(model.vocab, asked)
    vocab = vocab.withColumn("kind", F.when(F.col("kind") == "appended", "added").otherwise(F.col("kind")))
    known = model.added_tokens.withColumnRenamed("content", "token")
    registered = (
        vocab.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi")
        .join(known, "token", "left_anti")
        .select("token_id", F.col("token").alias("content"), F.lit(False).alias("special"))
    )
    return model.with_tables(vocab=vocab, added_tokens=model.added_tokens.unionByName(registered))


def special_tokens_map(model: BpeModel) -> DataFrame:
    """(role, content, token_id) for the end, padding and additional tokens of the model's profile."""
    profile = model.profile
    roles = [("eos_token", profile.eos), ("pad_token", profile.pad), *[("additional_special_tokens", t) for t in profile.additional]]
    rows = small_table(model.spark, [r for r in roles if r[1] is not None], "role string, content string")
    return rows.join(model.added_tokens.select("content", "token_id"), "content").select("role", "content", "token_id")


def special_token_uses(model: BpeModel, df: DataFrame, text: str = "text") -> DataFrame:
    """(role, content, token_id, n): how often each of them stands in the texts, cut longest first."""
    contents = [r.content for r in model.rows("added_tokens")]
    found = df.select(F.explode(split_special(F.col(text), contents)).alias("content")).where(F.col("content").isin(contents))
    counts = found.groupBy("content").agg(F.count("*").alias("n"))
    return special_tokens_map(model).join(counts, "content", "left").select("role", "content", "token_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def vocab_size(model: BpeModel) -> DataFrame:
    """Base size: tokens known when training ended, without those added later."""
    return model.vocab.where("kind <> 'added'").agg(F.count("*").alias("vocab_size"))


def token_id(model: BpeModel, content: str) -> int:
    row = model.vocab.where(F.col("token") == content).agg(F.min("token_id").alias("i")).first()
    if row.i is None:
        raise KeyError(content)
    return row.i


def pad_id(model: BpeModel) -> int:
    """Id of the padding token, or of the end token where no padding token is set."""
    ids = {r.token: r.token_id for r in reversed(model.rows("vocab"))}
    for token in (model.profile.pad, model.profile.eos):
        if token in ids:
            return ids[token]
    raise KeyError("neither a padding nor an end token")


def save_vocab(model: BpeModel, path: str) -> None:
    model.vocab.write.parquet(f"{path}/vocab")
    model.merges.write.parquet(f"{path}/merges")
    model.added_tokens.write.parquet(f"{path}/added_tokens")
    fields = asdict(model.profile)
    row = {**fields, "specials": list(fields["specials"]), "additional": list(fields["additional"])}
    schema = (
        "name string, normalizer string, splitter string, symbols string, specials array<string>, "
        "full_byte_alphabet boolean, max_piece int, protect_specials boolean, eos string, pad string, additional array<string>"
    )
    model.spark.createDataFrame([row], schema).write.parquet(f"{path}/profile")


def load_vocab(spark: SparkSession, path: str) -> BpeModel:
    row = spark.read.parquet(f"{path}/profile").first().asDict()
    return BpeModel(
        spark.read.parquet(f"{path}/vocab"),
        spark.read.parquet(f"{path}/merges"),
        spark.read.parquet(f"{path}/added_tokens"),
        Profile(**{**row, "specials": tuple(row["specials"]), "additional": tuple(row["additional"])}),
    )
