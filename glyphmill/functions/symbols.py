"""A piece as a string with one character per symbol.

Symbol ids map to code points in id order, so merging a pair is a plain ``replace`` (left to
right, without overlap), ordering strings orders ids, and both stay inside Spark's string
functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_FIRST = 0x100
_SURROGATES = 0xD800
MAX_SYMBOLS = 0x110000 - 0x800 - _FIRST


def code_char(symbol_id: int) -> str:
    if symbol_id >= MAX_SYMBOLS:
        raise ValueError(f"a vocabulary holds at most {MAX_SYMBOLS} symbols")
    point = _FIRST + symbol_id
    return chr(point if point < _SURROGATES else point + 0x800)


def symbol_id(char: str) -> int:
    point = ord(char)
    return point - _FIRST if point < _SURROGATES else point - _FIRST - 0x800


def symbol_id_column(char: Column) -> Column:
    """The id behind a code, as a column."""
    point = F.ascii(char)
    return point - _FIRST - F.when(point >= _SURROGATES, 0x800).otherwise(0)


def coded(col: Column, symbols: Sequence[str], ids: Sequence[int]) -> Column:
    """Replace each one-character symbol by its code; symbols without an id vanish.

    ``symbols`` lists every symbol that occurs; an id of ``None`` drops it.
    """
    kept = [(s, code_char(i)) for s, i in zip(symbols, ids) if i is not None]
    dropped = [s for s, i in zip(symbols, ids) if i is None]
    return F.translate(col, "".join(s for s, _ in kept) + "".join(dropped), "".join(c for _, c in kept))


_WHOLE = r"[^\uD800-\uDFFF]"  # keeps matches off half surrogates


def pairs_sql(name: str) -> str:
    """All overlapping pairs of neighbours, as SQL text."""
    return f"regexp_extract_all({name}, r'(?s)(?=({_WHOLE}.))', 1)"


def pairs_around_sql(name: str, lefts: str, rights: str) -> str:
    """Only the pairs whose left symbol is in ``lefts`` or whose right symbol is in ``rights``."""
    return f"regexp_extract_all({name}, r'(?s)(?=([{lefts}].|{_WHOLE}[{rights}]))', 1)"


def touches_sql(name: str, pairs: Sequence[str]) -> str:
    """Cheap over-approximation of "contains one of the pairs", as SQL text."""
    lefts = "".join(sorted({p[0] for p in pairs}))
    rights = "".join(sorted({p[1] for p in pairs}))
    return f"{name} RLIKE '[{lefts}][{rights}]'"


def merged_sql(name: str, merges: Sequence[tuple[str, str]]) -> str:
    """``(pair, symbol)`` merges applied in order, as SQL text.  Codes need no quoting."""
    if not merges:
        return name
    steps = ",".join(pair + symbol for pair, symbol in merges)
    step = "replace(acc, substring(m, 1, 2), substring(m, 3, 1))"
    return f"aggregate(split('{steps}', ','), {name}, (acc, m) -> {step})"
