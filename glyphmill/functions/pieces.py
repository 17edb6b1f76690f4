"""Cutting text into pieces and pieces into symbols, as JVM expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, SparkSession, functions as F

from glyphmill.fixed import DIGIT_PATTERN, PIECE_PATTERN
from glyphmill.functions.normalize import NORMALIZERS, normalized_segments

SPACE_MARK = "▁"


def _visible_bytes() -> str:
    """One visible character per byte: printable Latin-1 bytes stand for themselves, the
    others take U+0100 onwards in byte order."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF) or b == 0xAD]
    return "".join(chr(0x100 + hidden.index(b)) if b in hidden else chr(b) for b in range(256))


LATIN1 = "".join(map(chr, range(256)))
VISIBLE = _visible_bytes()


def find_all(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def split_pieces(col: Column) -> Column:
    return find_all(col, PIECE_PATTERN)


def split_digits(col: Column) -> Column:
    return find_all(col, DIGIT_PATTERN)


def latin1_bytes(col: Column) -> Column:
    """UTF-8 bytes of a string as characters U+0000 to U+00FF."""
    return F.decode(F.encode(col, "UTF-8"), "ISO-8859-1")


def visible_bytes(col: Column) -> Column:
    return F.translate(latin1_bytes(col), LATIN1, VISIBLE)


def byte_symbols(col: Column) -> Column:
    return find_all(visible_bytes(col), "(?s).")


def token_hex(col: Column) -> Column:
    """The bytes behind a token in visible form."""
    return F.hex(F.encode(F.translate(col, VISIBLE, LATIN1), "ISO-8859-1"))


def _any_of(contents: Sequence[str]) -> str:
    # Longest first: Java takes the first alternative that matches.  The class rules most
    # positions out at once.
    firsts = "".join(sorted({_quoted(c[0]) for c in contents}))
    return f"(?=[{firsts}])(?:{'|'.join(_quoted(c) for c in sorted(contents, key=lambda c: (-len(c), c)))})"


def _quoted(content: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", content, flags=re.ASCII)


def split_special(col: Column, contents: Sequence[str]) -> Column:
    """Cut out the given token texts, leftmost and longest first; the rest stays in segments."""
    if not contents:
        return F.when(F.length(col) > 0, F.array(col)).otherwise(F.array().cast("array<string>"))
    any_of = _any_of(contents)
    return find_all(col, rf"(?s){any_of}|.+?(?={any_of}|\z)")


# --- character profile -------------------------------------------------------------------
def _scripts() -> list[str]:
    """All scripts that the JVM knows, but for common and inherited signs and Han with kana, which count as one."""
    every = SparkSession.active().sparkContext._jvm.java.lang.Character.UnicodeScript.values()
    return [str(x) for x in every if str(x) not in ("COMMON", "INHERITED", "UNKNOWN", "HAN", "HIRAGANA", "KATAKANA")]


@cache
def word_pattern() -> str:
    digit = r"0-9\x{ff10}-\x{ff19}"
    kana_mark = r"\x{30fc}"
    scripts = [rf"\p{{Is{s}}}" for s in _scripts()] + [rf"\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}{kana_mark}"]
    runs = [rf"[{s}][{s}\p{{IsInherited}}]*+" for s in scripts]
    runs.append(rf"[\p{{IsCommon}}\p{{IsInherited}}\p{{IsUnknown}}&&[^{digit}{kana_mark}{SPACE_MARK}]]++")
    return rf"[{digit}]|{SPACE_MARK}?(?:{'|'.join(runs)})|{SPACE_MARK}"


def split_words(col: Column) -> Column:
    """Words led by the visible space, cut again where digits stand or the script changes."""
    return find_all(F.translate(col, " ", SPACE_MARK), word_pattern())


SPLITTERS = {
    "pieces": split_pieces,
    "digits": split_digits,
    "words": split_words,
    "none": lambda col: F.filter(F.array(col), lambda s: F.length(s) > 0),
}


def text_pieces(
    col: Column, normalizer: str = "nfc", splitter: str = "pieces", contents: Sequence[str] = ()
) -> Column:
    """Special texts first, then normalise and split each remaining segment."""

    split = SPLITTERS[splitter]
    if not contents:
        return split(NORMALIZERS[normalizer](col))
    special = col.rlike(_any_of(contents))
    fixed = F.array(*[F.lit(c) for c in contents])
    segments = F.when(special, split_special(col, contents))
    pieces = F.zip_with(
        segments,
        normalized_segments(segments, col, normalizer),
        lambda s, n: F.when(F.array_contains(fixed, s), F.array(s)).otherwise(split(n)),
    )
    return F.when(special, F.flatten(pieces)).otherwise(split(NORMALIZERS[normalizer](F.when(~special, col))))
