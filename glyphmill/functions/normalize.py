"""Unicode normalisers as deterministic columns.

An Arrow function hands each text to Python's own normaliser, a single native call.  Texts made
only of code points below the first one a form can change go in as nulls and come out as they
were, so they never cross into Python.
"""

from __future__ import annotations

import sys
import unicodedata

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from glyphmill.functions.steps import in_steps

# The first code point that a form can change.
_FIRST = {"NFC": 0x300, "NFKC": 0xA0, "NFD": 0xC0}


def _normal(texts: pa.Array, *forms: str) -> pa.Array:
    def changed(own: list) -> list:
        for form in forms:
            own = [None if t is None else unicodedata.normalize(form, t) for t in own]
        return own

    return in_steps(texts, changed, pa.string())


def _form_list(form: str):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def normalized(texts: pa.Array) -> pa.Array:
        def changed(rows: list) -> list:
            return [None if own is None else [unicodedata.normalize(form, t) for t in own] for own in rows]

        return in_steps(texts, changed, pa.list_(pa.string()))

    return normalized


def _form(form: str):
    @F.arrow_udf(T.StringType())
    def normalized(texts: pa.Array) -> pa.Array:
        return _normal(texts, form)

    return normalized


def _can_change(col: Column, form: str) -> Column:
    return col.rlike(rf"[^\x{{0}}-\x{{{_FIRST[form] - 1:x}}}]")


def _one(col: Column, form: str) -> Column:
    changed = _form(form)(F.when(_can_change(col, form), col))
    return F.coalesce(changed, col)


def normalize_nfc(col: Column) -> Column:
    return _one(col, "NFC")


def normalize_nfkc(col: Column) -> Column:
    return _one(col, "NFKC")


def normalize_nfd(col: Column) -> Column:
    return _one(col, "NFD")


def normalize_nfkc_strip(col: Column) -> Column:
    """NFKC, then drop marks that stayed separate; composed letters keep theirs."""
    return F.regexp_replace(normalize_nfkc(col), r"\p{M}+", "")


@F.arrow_udf(T.StringType())
def _decomposed(texts: pa.Array) -> pa.Array:
    """NFKC and then decomposed, in one call, so that the inner form is computed once."""
    return _normal(texts, "NFKC", "NFD")


def normalize_decompose_strip(col: Column) -> Column:
    """Drop NUL, NFKC, decompose, drop non-spacing marks; the result stays decomposed."""
    without_nul = F.translate(col, "\u0000", "")
    changed = _decomposed(F.when(_can_change(without_nul, "NFKC"), without_nul))
    return F.regexp_replace(F.coalesce(changed, without_nul), r"\p{Mn}+", "")


def _segments(segments: Column, wanted: Column, form: str, strip: str) -> Column:
    """Every string of an array in a form; ``wanted`` says which rows need it."""
    changed = F.coalesce(_form_list(form)(F.when(wanted, segments)), segments)
    return F.transform(changed, lambda s: F.regexp_replace(s, strip, "")) if strip else changed


NORMALIZERS = {
    "none": lambda col: col,
    "nfc": normalize_nfc,
    "nfkc_strip": normalize_nfkc_strip,
    "decompose_strip": normalize_decompose_strip,
}


def normalized_segments(segments: Column, text: Column, normalizer: str) -> Column:
    """The segments of a text, each in normal form by itself.

    A Python function cannot stand inside a lambda, so an array goes through it as a whole.
    """
    if normalizer == "none":
        return segments
    if normalizer == "nfc":
        return _segments(segments, _can_change(text, "NFC"), "NFC", "")
    if normalizer == "nfkc_strip":
        return _segments(segments, _can_change(text, "NFKC"), "NFKC", r"\p{M}+")
    cleared = F.transform(segments, lambda s: F.translate(s, "\u0000", ""))
    composed = _segments(cleared, _can_change(text, "NFKC"), "NFKC", "")
    return _segments(composed, _can_change(text, "NFKC"), "NFD", r"\p{Mn}+")


# Travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
