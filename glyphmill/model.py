"""A vocabulary as three small tables and the profile it was trained with."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from glyphmill.fixed import CHAT_ROLES, MAX_CHAR_PIECE, PLAIN_ROLES, SMALL_SPECIAL_TOKENS, SPECIAL_TOKENS
from glyphmill.functions.symbols import MAX_SYMBOLS

VOCAB_SCHEMA = "token string, token_id int, kind string, score double, token_hex string"
MERGES_SCHEMA = "rank int, left string, right string, merged string"
ADDED_SCHEMA = "token_id int, content string, special boolean"


@dataclass(frozen=True)
class Profile:
    """How text becomes symbols: normaliser, splitter, and bytes or characters."""

    name: str
    normalizer: str = "nfc"
    splitter: str = "pieces"
    symbols: str = "bytes"
    specials: tuple[str, ...] = tuple(SPECIAL_TOKENS)
    full_byte_alphabet: bool = False
    max_piece: int | None = None
    # Special texts are protected symbols while training, not ordinary text.
    protect_specials: bool = False
    # Which specials end a text, pad a row, and count as additional.
    eos: str | None = CHAT_ROLES[0]
    pad: str | None = CHAT_ROLES[1]
    additional: tuple[str, ...] = tuple(CHAT_ROLES[2])


BYTE_LEVEL = Profile("byte_level")
_PLAIN = {"eos": PLAIN_ROLES[0], "pad": PLAIN_ROLES[1], "additional": tuple(PLAIN_ROLES[2])}
DIGITS_ONLY = Profile("digits_only", "nfkc_strip", "digits", specials=tuple(SMALL_SPECIAL_TOKENS), **_PLAIN)
CHARACTERS = Profile(
    "characters",
    "none",
    "words",
    "chars",
    specials=tuple(SMALL_SPECIAL_TOKENS),
    max_piece=MAX_CHAR_PIECE,
    protect_specials=True,
    **_PLAIN,
)


@dataclass(frozen=True)
class BpeModel:
    vocab: DataFrame
    merges: DataFrame
    added_tokens: DataFrame
    profile: Profile
    # Rows that were fetched once; a model's tables never change.
    fetched: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.vocab.sparkSession

    def with_tables(self, **tables: DataFrame) -> "BpeModel":
        return replace(self, fetched={}, **tables)

    def rows(self, name: str) -> list:
        """The rows of ``vocab``, ``merges`` or ``added_tokens`` in id or rank order, fetched by one job at most."""
        if name not in self.fetched:
            order = "rank" if name == "merges" else "token_id"
            self.fetched[name] = bounded_rows(getattr(self, name).orderBy(order))
        return self.fetched[name]


def bounded_rows(df: DataFrame) -> list:
    """Rows of a model table, refused when there are more than a vocabulary can hold."""
    rows = df.limit(MAX_SYMBOLS + 1).collect()
    if len(rows) > MAX_SYMBOLS:
        raise ValueError("a model table must stay within the symbol space")
    return rows


def added_contents(model: BpeModel) -> list[str]:
    return [r.content for r in model.rows("added_tokens")]


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
