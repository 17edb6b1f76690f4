"""Text to token ids and back.

Encoding is a projection: no shuffle, no grouping, so a long document or a frequent piece
burdens nobody else.  The model tables travel as one broadcast, which the symbol space bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glyphmill.fixed import MAX_LENGTH
from glyphmill.functions.merging import batch_ids
from glyphmill.functions.normalize import NORMALIZERS
from glyphmill.functions.pieces import SPACE_MARK, find_all, text_pieces
from glyphmill.functions.steps import small_steps
from glyphmill.model import BpeModel, added_contents
from glyphmill.operators.counts import symbol_text
from glyphmill.operators.vocabulary import pad_id


def _tables(model: BpeModel) -> dict:
    vocab = model.rows("vocab")
    added = {r.content: r.token_id for r in model.rows("added_tokens")}
    plain = {r.token: r.token_id for r in vocab}
    tables = {"symbols": model.profile.symbols, "fixed": added, "memo": {}, "older": {}, "byte_ids": [None] * 256}
    if model.profile.symbols == "bytes":
        merges = model.rows("merges")
        tables["ranks"] = {}
        for r in merges:
            tables["ranks"].setdefault((plain[r.left], plain[r.right]), (r.rank, plain[r.merged]))
        for r in vocab:
            if r.kind == "byte":
                tables["byte_ids"][int(r.token_hex, 16)] = r.token_id
        return tables
    for r in vocab:
        if r.kind == "byte":
            tables["byte_ids"][int(r.token_hex, 16)] = r.token_id
    pieces = [r for r in vocab if r.kind in ("merge", "char", "appended")]
    tables["scores"] = {r.token: r.score for r in pieces if r.kind != "char"}
    tables["ids"] = {r.token: r.token_id for r in pieces}
    tables["unk"] = next(r.token_id for r in vocab if r.kind == "unknown")
    # A piece with an inner space would not survive cutting into words first.
    tables["spans_words"] = any(SPACE_MARK in r.token[1:] for r in pieces)
    return tables


def _encoder(model: BpeModel):
    """The piece column and the Arrow function that turns it into ids."""
    tables = _tables(model)
    broadcast = model.spark.sparkContext.broadcast(tables)
    profile = model.profile

    def pieces(text: Column) -> Column:
        contents = list(tables["fixed"])
        if profile.symbols == "bytes":
            return text_pieces(text, profile.normalizer, profile.splitter, contents)
        if tables["spans_words"] or profile.splitter != "words":
            marked = F.translate(text, " ", SPACE_MARK)
            return text_pieces(marked, profile.normalizer, "none", contents)
        return text_pieces(text, profile.normalizer, "words", contents)

    @F.arrow_udf("array<int>")
    def to_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in small_steps(batch):
                yield batch_ids(part, broadcast.value)

    return pieces, to_ids


def encode(df: DataFrame, model: BpeModel, text: str = "text", out: str = "input_ids") -> DataFrame:
    pieces, to_ids = _encoder(model)
    return df.withColumn(out, to_ids(pieces(F.col(text))))


def id_table(model: BpeModel, column: str, skip_special: bool = False) -> Column:
    """``token_hex`` or ``token`` of the model as a constant array indexed by id; ids without a row are empty."""
    rows = model.rows("vocab")
    hidden = set()
    if skip_special:
        hidden = {r.token_id for r in model.rows("added_tokens") if r.special}
    values = [""] * (max(r.token_id for r in rows) + 1)
    for r in rows:
        values[r.token_id] = "" if r.token_id in hidden else r[column]
    # A private character that no token holds keeps them apart.
    used = set("".join(values))
    between = next(c for c in map(chr, (*range(0xE000, 0xF900), *range(0xF0000, 0x10FFFE))) if c not in used)
    return F.split(F.lit(between.join(values)), between)


def _looked_up(ids: Column, table: Column) -> Column:
    return F.transform(ids, lambda i: F.try_element_at(table, i + 1))


def utf8_of_hex(hexed: Column) -> Column:
    """Bytes as text; invalid sequences become U+FFFD."""
    return F.call_function("make_valid_utf8", F.unhex(hexed).cast("string"))


def tokenize(df: DataFrame, model: BpeModel, text: str = "text", out: str = "tokens") -> DataFrame:
    """Token strings instead of ids."""
    ids = encode(df, model, text, "_ids")
    return ids.withColumn(out, _looked_up(F.col("_ids"), id_table(model, "token"))).drop("_ids")


def decoded(ids: Column, model: BpeModel, skip_special: bool = False) -> Column:
    return utf8_of_hex(F.array_join(_looked_up(ids, id_table(model, "token_hex", skip_special)), ""))


def decode(
    df: DataFrame, model: BpeModel, ids: str = "input_ids", out: str = "text", skip_special: bool = False
) -> DataFrame:
    return df.withColumn(out, decoded(F.col(ids), model, skip_special))


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def pad(ids: Column, max_length: int, pad_token_id: int) -> Column:
    missing = F.greatest(F.lit(max_length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad_token_id), missing))


def attention_mask(ids: Column, max_length: int) -> Column:
    """1 per token, 0 per padding position, for ids before padding."""
    missing = F.greatest(F.lit(max_length) - F.size(ids), F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing))


def fixed_rows(df: DataFrame, max_length: int, pad_token_id: int, ids: str = "input_ids") -> DataFrame:
    cut = truncate(F.col(ids), max_length)
    return df.withColumn(ids, cut).withColumns(
        {ids: pad(F.col(ids), max_length, pad_token_id), "attention_mask": attention_mask(F.col(ids), max_length)}
    )


def build_training_rows(
    df: DataFrame, model: BpeModel, max_length: int = MAX_LENGTH, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, input_ids, attention_mask, token_type_ids): encoded, cut and padded; other columns are gone.

    Token types are zeros of full length, as for single texts.
    """
    rows = fixed_rows(encode(df.select(key, text), model, text).drop(text), max_length, pad_id(model))
    return rows.withColumn("token_type_ids", F.array_repeat(F.lit(0), F.size("input_ids")))


def dropped_symbols(df: DataFrame, model: BpeModel, text: str = "text") -> DataFrame:
    """(symbol, n): symbols no vocabulary entry covers, which encoding leaves out."""
    profile, contents = model.profile, added_contents(model)
    pieces = F.explode(text_pieces(F.col(text), profile.normalizer, profile.splitter, contents)).alias("piece")
    # Pieces are counted first, so that only distinct ones are cut into symbols.
    plain = df.select(pieces).where(~F.col("piece").isin(contents)).groupBy("piece").agg(F.count("*").alias("n"))
    symbols = plain.select(F.explode(find_all(symbol_text(F.col("piece"), profile), "(?s).")).alias("symbol"), "n")
    counts = symbols.groupBy("symbol").agg(F.sum("n").alias("n"))
    known = model.vocab.where(F.col("kind").isin("byte", "char")).select(F.col("token").alias("symbol"))
    return counts.join(known, "symbol", "left_anti")


def roundtrip_check(df: DataFrame, model: BpeModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, decoded, same) where text is in the model's normal form."""
    rows = encode(df.select(key, text), model, text)
    normal = NORMALIZERS[model.profile.normalizer](F.col(text))
    rows = rows.select(key, normal.alias(text), decoded(F.col("input_ids"), model).alias("decoded"))
    return rows.withColumn("same", F.col(text) == F.col("decoded"))


def compare_vocab(
    first: BpeModel, second: BpeModel, df: DataFrame, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The same texts through two vocabularies, side by side; one pass, no join."""
    rows = df.select(key, text)
    for label, model in (("first", first), ("second", second)):
        rows = encode(rows, model, text, f"{label}_ids")
        rows = rows.withColumn(f"{label}_tokens", _looked_up(F.col(f"{label}_ids"), id_table(model, "token")))
    return rows.drop(text)
