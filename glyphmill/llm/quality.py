"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is an expression that is true for texts to reject.  On a sample, the time that a rule
takes and the share of texts that it rejects are estimated; the cascade then asks the rules in
the order of rejection per cost, and a text that one rule rejects is not looked at by those
after it.  The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from glyphmill.llm.common import SPACES, WORD, named

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SAMPLE_ROWS = 2000


def signs_in(text: Column, signs: str) -> Column:
    """How many of the text's characters are among ``signs``."""
    return F.length(text) - F.length(F.translate(text, signs, ""))


# Rules beyond the base: true means reject.  Columns: text, n_words, word_chars, n_symbols, n_lines, n_dup_lines.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "capitals": lambda: 2 * signs_in(F.col("text"), UPPER) > F.col("word_chars"),
    "marks": lambda: 2 * signs_in(F.col("text"), "!?") > F.col("n_words"),
    "digits": lambda: 2 * signs_in(F.col("text"), "0123456789") > F.col("word_chars"),
    "same_lines": lambda: 2 * F.col("n_dup_lines") > F.col("n_lines"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A column of an earlier projection may be put in place of its name when a filter is pushed
    down, and would then be computed anew for every element of an array; a lambda's variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash within one text.  Sorting them puts equal ones side by
    side, so the work grows with n log n; texts whose windows all differ are not sorted.
    """

    def hashes(w: Column) -> Column:
        spots = F.sequence(F.lit(1), F.size(w) - 2)
        return F.transform(spots, lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def ordered(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        def same(e: Column, at: Column) -> Column:
            return F.coalesce(e["h"] == F.get(s, at)["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")),
            lambda a: a["n"],
        )

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(ordered(h), lambda s: covered(twice(s)))).otherwise(F.lit(0).cast("long"))

    return _let(words, lambda w: F.when(F.size(w) >= 3, _let(hashes(w), counted)).otherwise(F.lit(0).cast("long")))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` and the counts; a null text counts as empty."""
    rows = named(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("w", F.filter(F.split("text", SPACES), lambda x: x != ""))
    rows = rows.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    return rows.select(
        "doc_id",
        "text",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        signs_in(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def cascade_order(docs: DataFrame, rules: dict[str, Callable[[], Column]] = RULES, rows: int = SAMPLE_ROWS, **columns: str) -> list[str]:
    """Rules by rejection per second, the best first, measured on about ``rows`` documents.

    The time of a rule is that of a pass over the kept sample, less that of a pass without rules.
    """
    total = docs.count()
    sample = measured(docs.sample(min(1.0, rows / max(1, total)), seed=7), **columns).persist()
    try:
        passed = sample.where(~base_failed())
        kept = max(1, passed.count())

        def run(rule: Column) -> tuple[float, int]:
            start = time.perf_counter()
            n = passed.agg(F.count_if(rule)).first()[0]
            return time.perf_counter() - start, n

        run(F.lit(False))
        idle = min(run(F.lit(False))[0] for _ in range(2))
        seen = {name: run(rule()) for name, rule in rules.items()}
    finally:
        sample.unpersist()
    gain = {name: (n / kept) / max(1e-3, seconds - idle) for name, (seconds, n) in seen.items()}
    return sorted(rules, key=lambda name: (-gain[name], name))


def judge(docs: DataFrame, order: list[str] | None = None, rules: dict[str, Callable[[], Column]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, ``base_failed``, ``kept``, and ``rejected_by``, the first rule of the cascade that rejects.

    Null and empty texts have no words and fail the base; repeated rows each get their row; no
    rows give no rows; other columns are ignored, whatever their names.
    """
    order = order or cascade_order(docs, rules, id_col=id_col, text_col=text_col)
    rows = measured(docs, id_col, text_col).withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), "base")
    for name in order:
        verdict = verdict.when(rules[name](), name)
    rows = rows.withColumn("rejected_by", verdict).drop("text")
    return rows.withColumn("kept", F.col("rejected_by").isNull())


ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM texts
), p AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM w, unnest(range(1, len(ws) - 1)) AS u(i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM p) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS s(k) GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts
), counted AS (
  SELECT doc_id, text, len(ws)::BIGINT AS n_words,
     length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
     length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
     (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
     coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM texts JOIN w USING (r) JOIN lines USING (r) LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
   NOT (base_failed OR 10 * n_symbols > n_words
     OR 2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > word_chars
     OR 2 * length(regexp_replace(text, '[^!?]+', '', 'g')) > n_words
     OR 2 * length(regexp_replace(text, '[^0-9]+', '', 'g')) > word_chars
     OR 2 * n_dup_lines > n_lines
     OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM judged
"""
