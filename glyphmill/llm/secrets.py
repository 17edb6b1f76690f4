"""Secrets: fixed forms, and tokens that a battery of tests takes for random.

Fixed forms (assignments, access keys, hexadecimal runs) are always reported.  Further tokens
are reported if they look drawn at random from their encoding.  Each candidate is tested for a
uniform use of its alphabet (chi-squared), for runs about the middle of the alphabet, and for
serial correlation; Fisher's method makes one p-value of the three.

Random tokens have p-values spread evenly between 0 and 1, tokens made by people have small
ones.  So the p-values of the whole corpus, counted in bins by encoding and length, tell how
many of the tokens above a bound are not random.  The bound of each encoding and length is the
lowest with an expected share of such tokens of at most ``RATE``: short tokens, on which the
tests have little power, need more than long ones.  Only the counts, of a fixed number of bins,
reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from glyphmill.llm.common import named
from glyphmill.session import written

KINDS = ("assign", "access", "hex", "random")
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# Runs are maximal, so asking for the least length at once finds the same ones.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
LEAST_ASSIGNED = 12

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Encodings from the narrowest to the widest; order within an alphabet is the order of its codes.
ENCODINGS = [
    ("decimal", _DIGITS),
    ("hex_upper", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36_lower", _DIGITS + _LOWER),
    ("base36_upper", _DIGITS + _UPPER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
]
_CODES = [{c: k for k, c in enumerate(alphabet)} for _, alphabet in ENCODINGS]
BINS, RATE, LENGTHS = 50, 0.05, 12
# Groups of bins whose evenness is tested, tokens that each must have on average, and the 1 % point of chi-squared for four free groups.
GROUPS, LEAST_EXPECTED, UNEVEN = 5, 5, 13.28


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed forms, in order; positions in code points."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def encoding_of(token: str) -> int | None:
    """The narrowest encoding that has all signs of a token."""
    signs = set(token)
    return next((k for k, codes in enumerate(_CODES) if signs <= codes.keys()), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_p(codes: list[int], size: int) -> float:
    """Upper tail of the chi-squared statistic against equal use of ``size`` signs (Wilson-Hilferty)."""
    n, free = len(codes), size - 1
    value = size / n * sum(c * c for c in Counter(codes).values()) - n
    z = ((value / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)) if value > 0 else -9.0
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs_p(codes: list[int], size: int) -> float:
    """Number of runs in the lower and the upper half of the alphabet."""
    high = [2 * c >= size for c in codes]
    a, n = sum(high), len(high)
    b = n - a
    if not a or not b:
        return 0.0
    mean = 1 + 2 * a * b / n
    spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    return _two_sided((1 + sum(x != y for x, y in zip(high, high[1:])) - mean) / spread)


def serial_p(codes: list[int]) -> float:
    """Correlation of neighbouring signs' codes."""
    n = len(codes)
    mean = sum(codes) / n
    around = [c - mean for c in codes]
    total = sum(x * x for x in around)
    return _two_sided(sum(x * y for x, y in zip(around, around[1:])) / total * math.sqrt(n)) if total else 0.0


def randomness_p(token: str, encoding: int) -> float:
    codes, size = [_CODES[encoding][c] for c in token], len(_CODES[encoding])
    half = -sum(math.log(max(p, 1e-300)) for p in (chi_squared_p(codes, size), runs_p(codes, size), serial_p(codes)))
    return math.exp(-half) * (1 + half + half * half / 2)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Tokens of at least 20 signs, with a digit or a change of case, apart from the fixed forms."""
    out = []
    for m in _CANDIDATE.finditer(text):
        token = m[0].rstrip("=")
        encoding = encoding_of(token) if _MIXED.search(token) else None
        if encoding is not None and not any(s < m.end() and e > m.start() for s, _, e in base):
            length = min(LENGTHS - 1, len(token).bit_length())
            out.append({"start": m.start(), "end": m.end(), "stratum": encoding * LENGTHS + length, "p": randomness_p(token, encoding)})
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = T.StructType(
    [
        T.StructField("base", SPANS),
        T.StructField(
            "more",
            T.ArrayType(
                T.StructType(
                    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("stratum", T.IntegerType()), T.StructField("p", T.DoubleType())]
                )
            ),
        ),
    ]
)


@F.arrow_udf(FOUND)
def _found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = []
        for value in batch:
            text = value.as_py() or ""
            base = base_spans(text)
            rows.append({"base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "more": candidates(text, base)})
        yield pa.array(rows, to_arrow_type(FOUND))


def bounds(counts: dict[tuple[int, int], int], rate: float = RATE) -> dict[int, float]:
    """Per stratum, the lowest p-value bound with an expected share of tokens that are not random of at most ``rate``.

    Random tokens fill all bins alike and others are rare in the upper half of the bins, so that half
    says how many random tokens a bin holds; what a bin holds beyond that is taken as not random.  A
    stratum gets no bound if its upper half has too few tokens to tell, or is not even by a
    chi-squared test over ``GROUPS`` groups of bins: then its tokens are not those of the model.
    """
    out = {}
    half = BINS // 2
    for stratum in {s for s, _ in counts}:
        own = [counts.get((stratum, b), 0) for b in range(BINS)]
        groups = [sum(own[half + k * half // GROUPS : half + (k + 1) * half // GROUPS]) for k in range(GROUPS)]
        expected = sum(groups) / GROUPS
        if expected < LEAST_EXPECTED or sum((g - expected) ** 2 for g in groups) / expected > UNEVEN:
            continue
        even = sum(groups) / half
        above = 0
        for b in reversed(range(BINS)):
            above += own[b]
            if above and above - even * (BINS - b) <= rate * above:
                out[stratum] = b / BINS
    return out


def find_secrets(docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` per row: arrays of start, kind (an index of ``KINDS``) and end, in order.

    Null and empty texts have no spans; repeated rows each get their row, and count as often in
    the statistics; no rows give no rows; other columns are ignored, whatever their names.
    """
    rows = named(docs, doc_id=id_col, text=text_col).withColumn("_f", _found(F.col("text")))
    rows = written(rows.select("doc_id", "_f"), "secrets").select("doc_id", "_f.base", "_f.more")
    bin_of = F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int")
    binned = rows.select(F.explode("more").alias("c")).groupBy(F.col("c.stratum").alias("s"), bin_of.alias("b")).agg(F.count("*").alias("n"))
    least = bounds({(r.s, r.b): r.n for r in binned.collect()}, rate)
    table = F.array(*[F.lit(least.get(s, 2.0)) for s in range(len(ENCODINGS) * LENGTHS)])
    random = F.filter("more", lambda c: c["p"] >= F.element_at(table, c["stratum"] + 1))
    added = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def written_spans(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
