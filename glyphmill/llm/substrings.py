"""Removal of long byte strings that occur more than once, with a logarithmic family of suffix tables.

Documents are dealt into batches, four at least and more as the text grows; one pass over the
text writes the suffixes of all of them.  A batch is a table of suffixes in the order of their
first bytes, is scanned together with the levels of earlier batches for beginnings in common, and
is then kept as a level of its own; levels of equal size are merged before the next batch and
those they came from dropped, so a suffix is rewritten a logarithmic number of times.

A suffix for every byte would be many times the text.  Kept are those that start at an anchor
(see ``anchors``): each 200-byte window has one, and equal windows have equal ones.  A row stands
for all neighbouring windows with the same anchor, and suffixes are ordered by a hash of their
first bytes, since only equality matters.  Rows whose beginning occurs once are done with.  Of
the others, those with equal bytes throughout are repeats as a whole; one of each kind, where a
beginning has several, is taken back to its text and compared window by window.

Equal rows are counted with partial sums, and found again by a broadcast of the few beginnings
and kinds that have very many; a beginning with very many continuations is split by the bytes that blocks of its
windows have in common.  The contexts of one block are compared in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from glyphmill.llm.anchors import PIECE, WINDOW, Hashed, anchor_runs
from glyphmill.llm.common import mixed64, named, small_batches, text_bytes
from glyphmill.session import WorkTables, new_path, written

# At least so many batches, so that levels merge, and no batch of more text than this.
BATCHES, BATCH_BYTES = 4, 16 << 30
# A beginning or kind of so many rows is broadcast; there are at most as many of them as rows divided by this.
FREQUENT = 4096
# Continuations of one beginning that are compared in one place, and windows in a block beyond that.
MANY, BLOCK = 4096, 16
STEP = 1 << 19
_SUFFIXES = "gram long, whole long, row long, start long, windows int, lead int"


def _pieces(rows: list[int], texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in steps of bounded size; long ones in overlapping pieces that share no window."""
    ids, offsets, own, size = [], [], [], 0
    for row, text in zip(rows, texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), PIECE):
            piece = text[at : at + PIECE + WINDOW - 1]
            ids.append(row)
            offsets.append(at)
            own.append(piece)
            size += len(piece)
            if size >= STEP:
                yield ids, offsets, own
                ids, offsets, own, size = [], [], [], 0
    if own:
        yield ids, offsets, own


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        for ids, offsets, texts in _pieces(batch.column("row").to_pylist(), text_bytes(batch.column("text"))):
            r = anchor_runs(texts)
            row, offset = np.array(ids, dtype=np.int64)[r.text], np.array(offsets, dtype=np.int64)[r.text]
            columns = [r.gram.view(np.int64), r.whole.view(np.int64), row, r.start + offset, r.windows.astype(np.int32), r.lead.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "whole", "row", "start", "windows", "lead"])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _of_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``keys``, which stand ``n`` times each; the rows of frequent ones stay where they are."""
    frequent = F.broadcast(keys.where(F.col("n") >= FREQUENT).select(*on))
    rare = rows.join(frequent, on, "left_anti").join(keys.where(F.col("n") < FREQUENT), on, "left_semi")
    return rows.join(frequent, on, "left_semi").unionByName(rare)


def suffix_batches(rows: DataFrame, work: WorkTables, batches: int) -> Iterator[tuple[DataFrame, str]]:
    """Suffix tables of all batches of ``row, text`` and their paths, sorted by beginning, from one pass over the text."""
    path = new_path(rows.sparkSession, "suffixes")
    work.paths.append(path)
    found = rows.select("row", "text").mapInArrow(_suffixes, _SUFFIXES).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))
    found.sortWithinPartitions("batch", "gram").write.partitionBy("batch").parquet(path)
    every = rows.sparkSession.read.schema(f"{_SUFFIXES}, batch int").parquet(path)
    for k in range(batches):
        own = f"{path}/batch={k}"
        work.paths.append(own)
        yield every.where(F.col("batch") == k).drop("batch"), own


class SuffixIndex:
    """Levels of suffix tables, ``(batches in it, table, path)``, the largest first."""

    def __init__(self, work: WorkTables):
        self.work = work
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.repeated: list[DataFrame] = []

    def add(self, own: DataFrame, path: str) -> None:
        """Take in a batch's suffixes, and note the beginnings that it shares with itself or earlier batches."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a, first), (m, b, second) = self.levels.pop(-2), self.levels.pop()
            merged = self.work.write(a.unionByName(b).repartition("gram").sortWithinPartitions("gram"), "suffixes")
            self.levels.append((n + m, merged, self.work.paths[-1]))
            self.work.drop(first)
            self.work.drop(second)
        grams = _union([own.select("gram", F.lit(1).alias("new")), *[t.select("gram", F.lit(0).alias("new")) for _, t, _ in self.levels]])
        twice = grams.groupBy("gram").agg(F.count("*").alias("n"), F.max("new").alias("new")).where("n > 1 and new = 1").select("gram", "n")
        self.repeated.append(self.work.write(twice, "beginnings"))
        self.levels.append((1, own, path))

    def candidates(self) -> DataFrame:
        """All suffixes whose beginning occurs more than once."""
        rows = _union([t for _, t, _ in self.levels])
        found = _union(self.repeated).groupBy("gram").agg(F.max("n").alias("n"))
        return _of_keys(rows, found, ["gram"])


_WANTED = "array<struct<start:bigint,windows:int,lead:int,gram:bigint,n:bigint,many:boolean>>"
_CONTEXTS = "key long, row long, start long, windows int, lead int, n long, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that the wanted windows cover; where a beginning has many continuations, block by block."""
    for batch in small_batches(batches, "text"):
        rows = []
        for row, text, wanted in zip(batch.column("row").to_pylist(), text_bytes(batch.column("text")), batch.column("wanted").to_pylist()):
            for w in wanted:
                start, n, lead = w["start"], w["windows"], w["lead"]
                if not w["many"]:
                    rows.append((w["gram"], row, start, n, lead, w["n"], text[start : start + n + WINDOW - 1]))
                    continue
                at = 0
                while at < n:
                    # Windows at the same distances from the anchor share the bytes between the last start and the first end.
                    block = (lead - at) // BLOCK
                    upto = min(n, lead - block * BLOCK + 1)
                    first, last = start + lead - (block * BLOCK + BLOCK - 1), start + lead - block * BLOCK
                    common = text[max(0, last) : first + WINDOW]
                    key = int.from_bytes(hashlib.blake2b(common, digest_size=8, key=w["gram"].to_bytes(8, "little", signed=True), salt=block.to_bytes(4, "little", signed=True)).digest(), "little", signed=True)
                    rows.append((key, row, start + at, upto - at, lead - at, w["n"], text[start + at : start + upto + WINDOW - 1]))
                    at = upto
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", "row", "start", "windows", "lead", "n", "bytes"]
        )


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that stand in two contexts of one key, from contexts sorted by key."""
    held: list[pa.RecordBatch] = []

    def compared(table: pa.Table) -> pa.RecordBatch:
        t = table.combine_chunks()
        key, row, start, windows, lead, n = (t.column(c).to_numpy() for c in ("key", "row", "start", "windows", "lead", "n"))
        contexts = t.column("bytes").to_pylist()
        sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
        begins = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(contexts)), windows)
        within = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begins[of] + within
        hashes = Hashed(np.frombuffer(b"".join(contexts), dtype=np.uint8)).of(at, at + WINDOW)
        same = hashes ^ mixed64(key[of].view(np.uint64) + (lead[of] - within).astype(np.uint64))
        _, group, count = np.unique(same, return_inverse=True, return_counts=True)
        # Kinds of which there are several are repeats already.
        hit = np.flatnonzero((count[group] > 1) & (n[of] == 1))
        new = np.flatnonzero(np.concatenate(([True], (of[hit][1:] != of[hit][:-1]) | (np.diff(hit) > 1)))) if len(hit) else hit
        length = np.diff(np.append(new, len(hit)))
        first = hit[new]
        s = start[of[first]] + within[first]
        return pa.RecordBatch.from_arrays([pa.array(row[of[first]]), pa.array(s), pa.array(s + length + WINDOW - 1)], ["row", "start", "end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column("key")[batch.num_rows - 1]
        open_ = pc.index(batch.column("key"), last).as_py()
        if open_ or held and held[-1].column("key")[0] != last:
            done = [*held, batch.slice(0, open_)]
            held = []
            if sum(b.num_rows for b in done):
                yield compared(pa.Table.from_batches(done))
        held.append(batch.slice(open_))
    if held:
        yield compared(pa.Table.from_batches(held))


def batches_for(rows: DataFrame) -> int:
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(BATCHES, -(-size // BATCH_BYTES))


def repeated_spans(rows: DataFrame, work: WorkTables, batches: int | None = None) -> DataFrame:
    """``row, start, end``: stretches of repeated windows of ``row, text``; they may overlap."""
    index = SuffixIndex(work)
    for own, path in suffix_batches(rows, work, batches or batches_for(rows)):
        index.add(own, path)
    kind = ["gram", "lead", "windows", "whole"]
    entries = work.write(index.candidates(), "candidates")
    for _, _, path in index.levels:
        work.drop(path)
    kinds = entries.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("one"))
    kinds = work.write(kinds, "kinds")
    same = _of_keys(entries, kinds.where("n > 1"), kind)
    whole = same.select("row", "start", (F.col("start") + F.col("windows") + (WINDOW - 1)).alias("end"))
    several = kinds.groupBy("gram").agg(F.count("*").alias("_kinds")).where("_kinds > 1")
    wanted = kinds.join(several, "gram").select(
        F.col("one.row").alias("row"),
        F.struct(F.col("one.start").alias("start"), "windows", "lead", "gram", "n", (F.col("_kinds") > MANY).alias("many")).alias("w"),
    )
    wanted = wanted.groupBy("row").agg(F.collect_list("w").cast(_WANTED).alias("wanted"))
    contexts = rows.select("row", "text").join(wanted, "row").mapInArrow(_contexts, _CONTEXTS)
    some = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_equal_windows, "row long, start long, end long")
    return whole.unionByName(some)


CUT = T.StructType([T.StructField(n, k) for n, k in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.BinaryType()))])


def _cutter(keep: bool):
    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(text_bytes(texts), spans.to_pylist()):
            kept, at, removed, n = [], 0, 0, 0
            end = -1
            for s in sorted((s["start"], s["end"]) for s in own or []):
                if s[0] > end:
                    kept.append(text[max(at, 0) : s[0]])
                    n += 1
                    end = s[0]
                removed += max(0, s[1] - end)
                end = at = max(end, s[1])
            rest = b"".join([*kept, text[at:]])
            out.append({"n_bytes": len(text), "n_removed": removed, "n_spans": n, "kept_sha256": hashlib.sha256(rest).hexdigest(), "kept": rest if keep else None})
        return pa.array(out, to_arrow_type(CUT))

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None, keep: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per row; ``kept`` are the remaining bytes.

    * null and empty texts, and texts under 200 bytes, lose nothing;
    * repeated rows are repeats of each other and lose all their windows; null doc_id: keeps its row;
    * no rows give no rows; other columns are ignored, whatever their names.

    ``docs`` must give the same rows in the same order when read again, as a scan does.
    """
    rows = named(docs, doc_id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    with WorkTables(docs.sparkSession) as work:
        spans = repeated_spans(rows, work, batches).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        spans = written(spans, "repeats")
    found = rows.join(spans, "row", "left").withColumn("_c", _cutter(keep)("text", "spans"))
    return found.select("doc_id", "_c.*")
