"""Benchmark decontamination with a generalised suffix automaton of test items.

The automaton is built from the items' words (ids of the items' own vocabulary) and holds
every run of words that occurs in some item.  Documents are streamed through it word by word:
its state gives the longest run, ending at the current word, that some item contains.  A window
of ``window`` words that occurs in an item is a position whose longest run is that long.

Items are taken in blocks of a bounded number of words, so what is broadcast never grows with
the benchmark: a larger benchmark means more passes over the documents, one automaton a pass, and
their hits are united before anything is decided about a document.  Each document is handled by
itself; nothing is shuffled unless there are several blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from glyphmill.llm.common import named, text_bytes
from glyphmill.session import written

# Of lower-cased UTF-8: digits, letters, and every byte of a character beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
# Words of items in one automaton; its tables take some 500 bytes a word.
BLOCK_WORDS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class ItemAutomaton:
    """Suffix automaton over items' word ids; each item starts at the root, so runs stay within one item."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)] for _, t in items]
        for seq in sequences:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        # Shorter items are windows of their own length: by state, its (length, item) pairs.
        self.whole: dict[int, list[tuple[int, int]]] = {}
        # Of the state that holds a full window: the items it occurs in.
        self.holders: dict[int, set[int]] = {}
        self.shortest = window
        for item, seq in enumerate(sequences):
            if seq and len(seq) < window:
                self.shortest = min(self.shortest, len(seq))
                self.whole.setdefault(self._walk(seq), []).append((len(seq), item))
            elif seq:
                for state in self._windows(seq):
                    self.holders.setdefault(state, set()).add(item)
        # The next state up the suffix links that is some short item as a whole.
        self.above = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            self.above[state] = up if up in self.whole else self.above[up] if up > 0 else -1

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        state = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            other = self.next[at][word]
            exact = self.length[other] == self.length[at] + 1
            self.link[state] = other if exact else self._split(at, word, other)
        return state

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, at: int, word: int, other: int) -> int:
        twin = self._state(self.length[at] + 1)
        self.next[twin] = dict(self.next[other])
        self.link[twin], self.link[other] = self.link[other], twin
        while at >= 0 and self.next[at].get(word) == other:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def _walk(self, seq: list[int]) -> int:
        state = 0
        for word in seq:
            state = self.next[state][word]
        return state

    def _windows(self, seq: list[int]) -> Iterator[int]:
        """The state of each full window of a sequence that the automaton holds."""
        state = length = 0
        for word in seq:
            state, length = self.step(state, length, word)
            if length >= self.window:
                yield self.of_length(state, self.window)

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest run that ends with ``word``, after the one given."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def of_length(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of the current run."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items that have an occurring window."""
        n = len(words)
        hit, items = np.zeros(n + 1, dtype=np.int32), set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=n)
        # Windows lie in runs of words that items know; shorter runs need no look.
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
        for start, end in zip(known[::2], known[1::2]):
            if end - start >= self.shortest:
                self._scan_run(ids[start:end].tolist(), int(start), hit, items)
        return np.cumsum(hit[:n]) > 0, items

    def _scan_run(self, ids: list[int], start: int, hit: np.ndarray, items: set[int]) -> None:
        state = length = 0
        for at, word in enumerate(ids, start):
            state, length = self.step(state, length, word)
            found = 0
            if length >= self.window:
                found = length
                items |= self.holders.get(self.of_length(state, self.window), set())
            short = state if state in self.whole else self.above[state]
            while short > 0:
                for size, item in self.whole[short]:
                    if size <= length:
                        items.add(item)
                        found = max(found, size)
                short = self.above[short]
            if found:
                hit[at - found + 1] += 1
                hit[at + 1] -= 1


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of at most ``block_words`` words (or one longer item), one block in memory at a time."""
    rows = named(items, item_id=id_col, text=text_col).select(F.col("item_id").cast("string").alias("item_id"), "text")
    block, size = [], 0
    for r in rows.toLocalIterator(prefetchPartitions=False):
        text = (r.text or "").encode()
        n = len(words_of(text))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r.item_id or "", text))
        size += n
    yield block


RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_runs", RUNS), T.StructField("items", T.ArrayType(T.StringType()))])


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    cuts = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(cuts[::2], cuts[1::2])]


def scanned(docs: DataFrame, automaton: ItemAutomaton, text: str) -> DataFrame:
    """``docs`` with a struct ``_hits``: number of words, hit runs of words, items with occurring windows."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    kind = to_arrow_type(HITS)

    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sam = shared.value
        for batch in batches:
            out = []
            for text in text_bytes(batch):
                words = words_of(text)
                hit, items = sam.scan(words)
                out.append({"n_words": len(words), "hit_runs": _runs(hit), "items": sorted({sam.names[i] for i in items})})
            yield pa.array(out, kind)

    # Declared so that it runs once per row, not once for a filter and once for the columns.
    return docs.withColumn("_hits", hits.asNondeterministic()(F.col(text)))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, hit_runs, n_hit, items`` per row of ``docs``.

    * null or empty text, on either side: no words; an item without words has no window;
    * a null item id counts as the empty id, repeated items are found under each of their ids;
    * repeated rows each get their row; an empty benchmark hits nothing; other columns are ignored.
    """
    rows = named(docs, doc_id=id_col, text=text_col)
    blocks = item_blocks(items, item_col, item_text, block_words)
    parts = []
    for block in blocks:
        base = rows.withColumn("_row", F.monotonically_increasing_id())
        parts.append(scanned(base, ItemAutomaton(block, window), "text").select("doc_id", "_row", "_hits.*"))
    if len(parts) == 1:
        found = parts[0]
    else:
        united = written(parts[0], "hits")
        for part in parts[1:]:
            united = united.unionByName(written(part.where(F.size("items") > 0), "hits"))
        found = united.groupBy("_row").agg(
            F.first("doc_id", ignorenulls=True).alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("hit_runs")).alias("hit_runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        found = found.withColumn("hit_runs", united_runs("hit_runs"))
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda t, r: t + r["end"] - r["start"])
    return found.select("doc_id", "n_words", "hit_runs", n_hit.alias("n_hit"), "items")


@F.arrow_udf(RUNS)
def united_runs(runs: pa.Array) -> pa.Array:
    """Runs of several scans of one document as disjoint runs in order."""
    out = []
    for own in runs.to_pylist():
        merged: list[dict[str, int]] = []
        for r in sorted(own or [], key=lambda r: (r["start"], r["end"])):
            if merged and r["start"] <= merged[-1]["end"]:
                merged[-1]["end"] = max(merged[-1]["end"], r["end"])
            else:
                merged.append(dict(r))
        out.append(merged)
    return pa.array(out, to_arrow_type(RUNS))


def cut_spans(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the given runs of words, and without what stands inside them; a line feed marks each cut."""
    spots = [m.span() for m in _WORD.finditer(text.lower())]
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at : spots[a][0]])
        at = spots[b - 1][1]
    kept.append(text[at:])
    return b"\n".join(kept)


def _cleaner(shared, min_words: int, max_coverage: float):
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("keep", T.BooleanType())])

    @F.arrow_udf(kind)
    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = shared.value
        least = min(min_words, automaton.shortest)
        for batch in batches:
            rows = []
            for text, null in zip(text_bytes(batch), batch.is_null().to_pylist()):
                words, keep = words_of(text), True
                while keep:
                    hit, _ = automaton.scan(words)
                    runs = [(r["start"], r["end"]) for r in _runs(hit) if r["end"] - r["start"] >= least]
                    if not runs:
                        break
                    keep = sum(b - a for a, b in runs) <= max_coverage * len(words)
                    text = cut_spans(text, runs)
                    words = words_of(text)
                rows.append({"text": None if null else text.decode(), "keep": keep})
            yield pa.array(rows, to_arrow_type(kind))

    # Declared so that it runs once per row, not once for the filter and once for the columns.
    return cleaned.asNondeterministic()


def _cutter(least: int, max_coverage: float):
    """One round of ``_cleaner`` with the hit runs given: the text after the cuts, and whether it stays and was cut."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("keep", T.BooleanType()), T.StructField("cut", T.BooleanType())])

    @F.arrow_udf(kind)
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        rows = []
        for text, own in zip(text_bytes(texts), runs.to_pylist()):
            spans = [(r["start"], r["end"]) for r in own if r["end"] - r["start"] >= least]
            keep = sum(b - a for a, b in spans) <= max_coverage * len(words_of(text))
            rows.append({"text": cut_spans(text, spans).decode() if spans else text.decode(), "keep": keep, "cut": bool(spans)})
        return pa.array(rows, to_arrow_type(kind))

    return cut.asNondeterministic()


def _cleaned_by_blocks(docs: DataFrame, blocks: Callable[[], Iterator[ItemAutomaton]], min_words: int, max_coverage: float, text_col: str) -> DataFrame:
    """What ``_cleaner`` gives with one automaton of all items, with one block's automaton in memory at a time.

    Every round unites the hits of all blocks per document and cuts once; what was cut is looked
    at again by all blocks until none finds anything.
    """
    base = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")), "decontaminate")
    left = base.select("_row", F.col(f"_doc.`{text_col}`").alias("text"))
    rounds = []
    while True:
        hits, least = [], min_words
        for automaton in blocks():
            least = min(least, automaton.shortest)
            found = scanned(left, automaton, "text").select("_row", "_hits.hit_runs")
            hits.append(written(found.where(F.size("hit_runs") > 0), "hits"))
        united = reduce(DataFrame.unionByName, hits).groupBy("_row").agg(F.flatten(F.collect_list("hit_runs")).alias("runs"))
        changes = left.join(united.select("_row", united_runs("runs").alias("runs")), "_row")
        changes = changes.withColumn("_clean", _cutter(least, max_coverage)("text", "runs")).select("_row", "_clean.*")
        changes = written(changes.where("cut"), "cuts")
        if changes.isEmpty():
            break
        rounds.append(changes.select("_row", F.struct(F.lit(len(rounds)).alias("round"), "keep", "text").alias("last")))
        left = changes.where("keep").select("_row", "text")
    out = base.withColumn("last", F.lit(None).cast("struct<round int, keep boolean, text string>"))
    if rounds:
        last = reduce(DataFrame.unionByName, rounds).groupBy("_row").agg(F.max("last").alias("last"))
        out = base.join(last, "_row", "left").where("last is null or last.keep")
    columns = [(F.coalesce("last.text", own) if c == text_col else own).alias(c) for c in docs.columns for own in [F.col(f"_doc.`{c}`")]]
    return out.select(*columns)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    min_words: int = WINDOW,
    max_coverage: float = 0.5,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with contaminated spans cut out of their texts.

    A hit run of at least ``min_words`` words, or a shorter item as a whole, is a span.  A
    document of which more than ``max_coverage`` of the words are in spans is dropped; from
    others the spans are removed, and the rest is looked at again until nothing is found.
    The result does not depend on ``block_words``.  Null and empty texts pass unchanged.
    """
    blocks = item_blocks(items, item_col, item_text, block_words)
    first, more = next(blocks), next(blocks, None)
    blocks.close()
    if more is not None:
        del first, more
        automata = lambda: (ItemAutomaton(block, window) for block in item_blocks(items, item_col, item_text, block_words))
        return _cleaned_by_blocks(docs, automata, min_words, max_coverage, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(first, window))
    clean = _cleaner(shared, min_words, max_coverage)(F.col(f"`{text_col}`"))
    columns = [F.col("_clean.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn("_clean", clean).where("_clean.keep").select(*columns)
