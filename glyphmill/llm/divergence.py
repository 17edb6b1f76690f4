"""How far the sources of a language diverge from each other, term by term.

Every (lang, source) group is a row of a count matrix, every kept term of the language a column.
Counts become smoothed shares in billionths, and the divergence of p from q is the sum over the
columns of ``floor((p - q)**2 / q)``; all of it is whole numbers.

The matrix is cut into tiles of at most ``2 * BAND`` rows and about ``COLUMNS`` columns, so that no
task holds a whole row, a whole column or all groups.  In a tile the counts that are not zero are
the leaves of a quadtree: each level halves rows and columns, and a quadrant without a leaf ends
there.  Pairs of rows walk down the tree together.  Where neither row's quadrant holds a leaf, all
columns in it have the same price, which depends on the two rows alone; they are priced by their
number.  Leaves are priced one by one.  Columns are ordered by the rows they occur in, so empty
quadrants are large.

Rows: null texts, langs and sources are empty ones; every (lang, source) that occurs is a group, with
or without terms; repeated rows count each; a language without kept terms has pairs of value 0;
ids and other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.llm.common import named, small_batches, text_bytes
from glyphmill.session import written

BILLION = 1_000_000_000
MIN_DOCS, TOP_TERMS = 3, 200
# Rows of a band and columns of a block; a tile joins two bands.
BAND, COLUMNS = 64, 1 << 13
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: occurrences of a term in a group, and the rows that hold it."""
    for batch in small_batches(batches, "text"):
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = np.asarray(lang.indices, dtype=np.int64) * len(source.dictionary) + np.asarray(source.indices)
        words = [text.translate(_LETTERS).split() for text in text_bytes(batch.column("text"))]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        coded = pa.array((w for own in words for w in own), pa.large_binary()).dictionary_encode()
        if not len(coded):
            continue
        terms = [t.decode("utf-8", "replace") for t in coded.dictionary.to_pylist()]
        wide = np.int64(len(terms))
        cells, n = np.unique(np.repeat(np.arange(len(words)), sizes) * wide + np.asarray(coded.indices), return_counts=True)
        keys = group[cells // wide] * wide + cells % wide
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
        docs = np.diff(np.append(starts, len(keys)))
        keys = keys[order][starts]
        yield pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array(keys // wide // len(source.dictionary))),
                source.dictionary.take(pa.array(keys // wide % len(source.dictionary))),
                pa.array(terms, pa.string()).take(pa.array(keys % wide)),
                pa.array(np.add.reduceat(n[order], starts), pa.int64()),
                pa.array(docs, pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10**9 * (n + 1) / (total + terms))``, in numbers wide enough for any count."""
    wide = (n + 1).cast("decimal(19,0)") * F.lit(BILLION).cast("decimal(10,0)")
    return F.expr("1L") + F.call_function("div", wide, (total + terms).cast("decimal(20,0)"))


def divergence(p, q):
    return (p - q) * (p - q) // q


class Matrix:
    """``docs`` counted: kept cells, languages and groups, each a table of the shared folder."""

    def __init__(
        self,
        docs: DataFrame,
        lang_col: str = "lang",
        source_col: str = "source",
        text_col: str = "text",
        min_docs: int = MIN_DOCS,
        band: int = BAND,
        columns: int = COLUMNS,
    ):
        rows = named(docs, lang=lang_col, source=source_col, text=text_col).fillna("", ["lang", "source"])
        found = rows.mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long")
        counts = written(found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        kept = written(kept.select(F.monotonically_increasing_id().alias("term_id"), "lang", "term", "lang_n"), "kept-terms")
        self.langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
        self.cells = written(counts.drop("docs").join(kept, ["lang", "term"]), "cells")
        totals = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        none = F.lit(0).cast("long")
        groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(self.langs, "lang", "left")
        groups = groups.fillna(0, ["total", "terms", "lang_total"])
        last = F.count("*").over(Window.partitionBy("lang")) - 1
        row = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        self.groups = written(
            groups.select(
                "lang",
                "source",
                row.alias("row"),
                F.floor(row / band).cast("int").alias("band"),
                F.floor(last / band).cast("int").alias("last_band"),
                "total",
                "terms",
                "lang_total",
                F.floor(F.greatest(F.col("terms") - 1, none) / columns).alias("last_block"),
                # Without kept terms there is nothing to price; any share will do.
                share(none, F.col("total"), F.greatest("terms", F.lit(1))).alias("p0"),
            ),
            "groups",
        )

    def shares(self) -> DataFrame:
        """Cells with their group's row and share and the language's share."""
        joined = self.cells.join(self.groups, ["lang", "source"])
        p = share(F.col("n"), F.col("total"), F.col("terms"))
        q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
        return joined.withColumns({"p": p, "q": q})


_MEMBER = ["lang", "block", "first", "second", "row", "band", "p0", "terms", "term_id", "p"]
_PAIRS = "lang string, row int, other int, terms long, price long, leaves long, value long"


def _tiles(matrix: Matrix) -> DataFrame:
    """Rows of all tiles: the cells, and for each group of a tile one head without a term."""
    band = F.col("band")
    pairs = F.transform(F.sequence(F.lit(0), F.col("last_band")), lambda o: F.struct(F.least(o, band).alias("first"), F.greatest(o, band).alias("second")))
    nothing = F.lit(None).cast("long")
    heads = matrix.groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_block"))))
    heads = heads.select("lang", "block", F.inline(pairs), "row", "band", "p0", "terms", nothing.alias("term_id"), nothing.alias("p"))
    # Columns of a language go to its blocks by a hash of their number.
    block = F.pmod(F.xxhash64("term_id"), F.col("last_block") + 1).alias("block")
    cells = matrix.shares().select("lang", block, F.inline(pairs), "row", "band", "p0", "terms", "term_id", "p")
    return heads.select(_MEMBER).unionByName(cells.select(_MEMBER))


class Quadtree:
    """Cells that are not zero, as one bitmap of non-empty quadrants per level."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int):
        self.depth = max(1, int(max(n_rows, n_columns) - 1).bit_length())
        self.levels = []
        for shift in range(self.depth, -1, -1):
            bitmap = np.zeros(((n_rows - 1 >> shift) + 1, (max(n_columns, 1) - 1 >> shift) + 1), bool)
            bitmap[rows >> shift, columns >> shift] = True
            self.levels.append(bitmap)

    def leaves(self, row: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``others`` and columns where ``row`` or the other row has a leaf, going down together."""
        at, column = np.arange(len(others)), np.zeros(len(others), np.int64)
        for level, bitmap in enumerate(self.levels):
            shift = self.depth - level
            if level:
                at, column = np.repeat(at, 2), np.repeat(2 * column, 2)
                column[1::2] += 1
                inside = column < bitmap.shape[1]
                at, column = at[inside], column[inside]
            live = bitmap[row >> shift, column] | bitmap[others[at] >> shift, column]
            at, column = at[live], column[live]
        return at, column


def _priced(key: tuple, tile: pa.Table) -> pa.Table:
    """Sums over the leaves of each ordered pair of rows in a tile, their number, and the price of any other column."""
    first, second = key[2].as_py(), key[3].as_py()
    number, p0, terms, ids, p = (tile.column(c) for c in ("row", "p0", "terms", "term_id", "p"))
    is_head = np.asarray(ids.is_null())
    number = np.asarray(number)
    order = np.argsort(number[is_head])
    rows, zero, band = (c[is_head][order] for c in (number, np.asarray(p0), np.asarray(tile.column("band"))))
    cell_rows = np.searchsorted(rows, number[~is_head])
    columns, cell_columns = np.unique(np.asarray(ids.drop_null()), return_inverse=True)
    # Columns that occur in the same rows stand together.
    low, high = np.full(len(columns), len(rows)), np.full(len(columns), -1)
    np.minimum.at(low, cell_columns, cell_rows)
    np.maximum.at(high, cell_columns, cell_rows)
    place = np.empty(len(columns), np.int64)
    place[np.lexsort((high, low))] = np.arange(len(columns))
    cell_columns = place[cell_columns]
    shares = np.repeat(zero[:, None], max(1, len(columns)), axis=1)
    shares[cell_rows, cell_columns] = np.asarray(p.drop_null())
    tree = Quadtree(cell_rows, cell_columns, len(rows), len(columns))
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for r in range(len(rows)):
        others = np.flatnonzero((band == (second if band[r] == first else first)) & (np.arange(len(rows)) != r))
        at, column = tree.leaves(r, others)
        values = np.concatenate((divergence(shares[r, column], shares[others[at], column]), [0]))
        # Down the tree the order of the others stays; an empty run must not take its neighbour's value.
        leaves = np.bincount(at, minlength=len(others))
        starts = np.cumsum(leaves) - leaves
        sums = np.where(leaves > 0, np.add.reduceat(values, starts) if len(others) else 0, 0)
        for kept, own in zip(out, (np.full(len(others), rows[r]), rows[others], divergence(zero[r], zero[others]), leaves, sums)):
            kept.append(own)
    row, other, price, leaves, sums = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
    n = len(row)
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * n, pa.string()),
            "row": pa.array(row, pa.int32()),
            "other": pa.array(other, pa.int32()),
            "terms": pa.array(np.full(n, terms[0].as_py()), pa.int64()),
            "price": pa.array(price, pa.int64()),
            "leaves": pa.array(leaves, pa.int64()),
            "value": pa.array(sums, pa.int64()),
        }
    )


def pair_divergence(matrix: Matrix) -> DataFrame:
    """``lang, source, other, value`` for every ordered pair of a language's sources."""
    tiles = _tiles(matrix).groupBy("lang", "block", "first", "second").applyInArrow(_priced, _PAIRS)
    sums = tiles.groupBy("lang", "row", "other").agg(
        F.sum("value").alias("value"), F.sum("leaves").alias("leaves"), F.max("price").alias("price"), F.max("terms").alias("terms")
    )
    value = F.col("value") + (F.col("terms") - F.col("leaves")) * F.col("price")
    names = matrix.groups.select("lang", "row", "source")
    others = names.select("lang", F.col("row").alias("other"), F.col("source").alias("other_source"))
    named_pairs = sums.join(names, ["lang", "row"]).join(others, ["lang", "other"])
    return named_pairs.select("lang", "source", F.col("other_source").alias("other"), value.alias("value"))


def raised_terms(matrix: Matrix, most: int | None = TOP_TERMS) -> DataFrame:
    """``lang, source, term, value, rank``: a group's terms whose share is above the language's, the furthest first."""
    p, q = F.col("p"), F.col("q")
    value = F.call_function("div", (p - q).cast("decimal(19,0)") * (p - q).cast("decimal(19,0)"), q.cast("decimal(19,0)"))
    found = matrix.shares().where(p > q).select("lang", "source", "term", value.alias("value"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def audit(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    top_terms: int | None = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has all other sources, part ``term`` the leading terms."""
    matrix = Matrix(docs, lang_col, source_col, text_col, min_docs)
    pairs = pair_divergence(matrix).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).withColumnRenamed("other", "item")
    terms = raised_terms(matrix, top_terms).withColumn("part", F.lit("term")).withColumnRenamed("term", "item")
    return pairs.select(columns).unionByName(terms.select(columns))


ORACLE = r"""
WITH rows_ AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows_
), kept AS (
    SELECT lang, term, count(*)::HUGEINT AS c FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), cells AS (
    SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS c FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
    SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang
), groups_ AS (
    SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n
    FROM (SELECT DISTINCT lang, source FROM rows_) g LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source
    GROUP BY g.lang, g.source
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (g.n + l.v) AS p,
           1 + (1000000000 * (k.c + 1)) // (l.n + l.v) AS q
    FROM groups_ g JOIN langs l USING (lang) JOIN kept k USING (lang)
    LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
        FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), terms AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (
    SELECT lang, source, 'term' AS part, item, value,
           row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
) WHERE rank <= 200
"""
