"""Corpus-wide counting: pieces, alphabet, adjacent pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.functions.pieces import find_all, text_pieces, visible_bytes
from glyphmill.functions.symbols import merged_sql, pairs_sql
from glyphmill.model import Profile


def corpus_pieces(text: Column, profile: Profile) -> Column:
    """Pieces a trainer sees. Special-looking text is ordinary unless the profile protects it."""
    contents = profile.specials if profile.protect_specials else ()
    pieces = text_pieces(text, profile.normalizer, profile.splitter, contents)
    if not contents:
        return pieces
    return F.filter(pieces, lambda p: ~p.isin(list(contents)))


def piece_counts(df: DataFrame, profile: Profile, text: str = "text") -> DataFrame:
    """(piece, n). Hash aggregation combines before the shuffle, so a hot piece stays cheap."""
    pieces = df.select(F.explode(corpus_pieces(F.col(text), profile)).alias("piece"))
    return pieces.groupBy("piece").agg(F.count("*").alias("n"))


def symbol_text(piece: Column, profile: Profile) -> Column:
    """A piece as visible symbols, one character each."""
    return visible_bytes(piece) if profile.symbols == "bytes" else piece


def char_alphabet(pieces: DataFrame, profile: Profile, coverage: float = 1.0) -> DataFrame:
    """(symbol, n, position): symbols in code point order, with occurrences in the corpus.

    Below full coverage the rarest symbols go, keeping the smallest set of most frequent
    symbols that reaches the share. The windows run over at most one row per character.
    """
    symbols = pieces.select(F.explode(find_all(symbol_text(F.col("piece"), profile), "(?s).")).alias("symbol"), "n")
    counts = symbols.groupBy("symbol").agg(F.sum("n").alias("n"))
    if coverage < 1.0:
        down = Window.orderBy(F.desc("n"), "symbol")
        before = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("n").over(Window.partitionBy())
        counts = counts.withColumn("share", before / total).where(F.col("share") < coverage).drop("share")
    return counts.withColumn("position", F.row_number().over(Window.orderBy("symbol")) - 1)


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, n) over coded words (syms, n), overlapping pairs included."""
    pairs = words.where(F.length("syms") > 1).selectExpr(f"explode({pairs_sql('syms')}) AS pair", "n")
    return pairs.groupBy("pair").agg(F.sum("n").alias("n"))


def top_pairs(pairs: DataFrame, k: int, min_frequency: int = 1, ties: Sequence[Column] = ()) -> DataFrame:
    """Most frequent first; ties by the given columns, else by lower left id, then lower right id."""
    return pairs.where(F.col("n") >= max(min_frequency, 1)).orderBy(F.desc("n"), *ties, "pair").limit(k)


def apply_merges(words: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    return words.withColumn("syms", F.expr(merged_sql("syms", merges)))
