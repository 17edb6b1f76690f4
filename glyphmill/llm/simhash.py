"""Near duplicates by SimHash with pigeonring filtering.

Fingerprints are cut into a ring of ``SEGMENTS`` segments.  If two fingerprints differ in at
most ``t`` bits there is a segment from which every run of consecutive segments, of any length
``l``, differs in at most ``l * t / SEGMENTS`` bits.  For 4 bits and 5 segments the budgets along
the chain are 0, 1, 2, 3 and 4.  The first two steps of the chain make the join key: one whole
segment, and the next one without one of its bits.  The later steps prune what shares a key
before the full comparison.

Rows with one key are sorted next to each other and read as a stream.  A large group of rows
with one key is cut further by the third step of the chain, so it costs sorts, not all pairs;
what leaves a group is a spanning forest of its links.  Copies never enter: they are one
fingerprint with a least document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from glyphmill.llm.common import text_bytes
from glyphmill.llm.components import components
from glyphmill.session import WorkTables, written

SHINGLE, SEED, MOST_BITS = 4, 42, 4
SEGMENTS = 5
# Groups up to this size are compared pair by pair, in one block.
GROUP = 2048


def fingerprint(text: bytes) -> int:
    """64 bits, each the majority over the shingles' hashes; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array(np.array([fingerprint(t) for t in text_bytes(batch)], dtype=np.uint64).view(np.int64))


def _segments() -> list[list[int]]:
    return [list(map(int, bits)) for bits in np.array_split(np.arange(64), SEGMENTS)]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def chain_masks() -> list[tuple[int, int]]:
    """``(first segment, kept bits)`` of every join key."""
    ring, out = _segments(), []
    for start in range(SEGMENTS):
        after = ring[(start + 1) % SEGMENTS]
        out += [(start, _mask(ring[start]) | _mask(after) & ~(1 << bit)) for bit in after]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chained(a: np.ndarray, b: np.ndarray, start: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Whether pairs stay within the budget at every step of the chain, and so at the last in full."""
    ring, differing = _segments(), a ^ b
    steps = np.array([[_mask(x for k in range(n) for x in ring[(s + k) % SEGMENTS]) for n in range(3, SEGMENTS + 1)] for s in range(SEGMENTS)], dtype=np.uint64)
    good = np.ones(len(a), dtype=bool)
    for n in range(3, SEGMENTS + 1):
        left = np.flatnonzero(good)
        count = np.bitwise_count(differing[left] & steps[start[left], n - 3])
        good[left[count > n * most // SEGMENTS]] = False
    return good


class _Forest:
    """Spanning forest of the links seen within one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def group_links(group: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints that share a key."""
    group = np.unique(group)
    forest, out = _Forest(len(group)), []

    def compare(own: np.ndarray) -> None:
        for k in range(len(own) - 1):
            others = own[k + 1 :]
            near = others[np.bitwise_count(group[others] ^ group[own[k]]) <= MOST_BITS]
            out.extend((own[k], other) for other in near.tolist() if forest.join(int(own[k]), other))

    if len(group) <= GROUP:
        compare(np.arange(len(group)))
    else:
        # Third step of the chain: at most two more differing bits in the third segment.
        third = _segments()[(start + 2) % SEGMENTS]
        for bits in combinations(third, 2):
            kept = group & np.uint64(_mask(third) & ~_mask(bits))
            order = np.argsort(kept, kind="stable")
            cuts = np.flatnonzero(np.diff(kept[order])) + 1
            for own in np.split(order, cuts):
                # A part that is one tree already has nothing to add.
                if len(own) > 1 and len({forest.root(int(x)) for x in own}) > 1:
                    compare(own)
    return [(int(group[a]), int(group[b])) for a, b in out]


def _stream_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows with equal keys, from rows sorted by key; a group may span batches."""
    starts = np.array([s for s, _ in chain_masks()])
    empty = np.empty(0, dtype=np.int64)
    rest = (empty, empty, np.empty(0, dtype=np.uint64))

    def links(kind: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]))) if len(kind) else np.empty(0, dtype=bool)
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(kind)))
        group = np.repeat(np.arange(len(first)), sizes)
        small = (sizes <= 8)[group] if len(first) else np.empty(0, dtype=bool)
        a, b = [], []
        for step in range(1, 8):
            at = np.flatnonzero((group[step:] == group[:-step]) & small[:-step])
            at = at[_chained(fp[at], fp[at + step], starts[kind[at]])]
            a.append(fp[at])
            b.append(fp[at + step])
        for f, n in zip(first[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
            found = np.array(group_links(fp[f : f + n], int(starts[kind[f]])), dtype=np.uint64).reshape(-1, 2)
            a.append(found[:, 0])
            b.append(found[:, 1])
        pairs = np.stack([np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)], axis=1)
        pairs.sort(axis=1)
        pairs = np.unique(pairs, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        now = [np.asarray(batch.column(k)) for k in range(3)]
        now[2] = now[2].view(np.uint64)
        kind, key, fp = (np.concatenate(x) for x in zip(rest, now))
        last = len(kind) and int(np.flatnonzero((kind != kind[-1]) | (key != key[-1]))[-1:].sum() + ((kind != kind[-1]) | (key != key[-1])).any())
        yield links(kind[:last], key[:last], fp[:last])
        rest = (kind[last:], key[last:], fp[last:])
    yield links(*rest)


def near_links(prints: DataFrame) -> DataFrame:
    """``a, b``: links among the distinct fingerprints of a column ``fp``, enough of them for the same components."""
    masks = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(_signed(m)).alias("mask")) for k, (_, m) in enumerate(chain_masks())])
    keyed = prints.select("fp", F.explode(masks).alias("m")).select(
        F.col("m.kind").cast("long").alias("kind"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp"
    )
    spread = keyed.repartition("kind", "key").sortWithinPartitions("kind", "key")
    return spread.mapInArrow(_stream_links, "a long, b long")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def with_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``doc_id, row, fp, component_id, root`` per row.

    ``row`` tells rows with equal ids apart and is a number of its own without ``row_col``; ``root`` is
    one fingerprint of the component, and tells components apart whose least ids are equal.

    * null text, or one without words: fingerprint 0, linked like any other;
    * null doc_id: keeps its row; a component of such rows alone has a null id;
    * repeated rows share fingerprint and component; no rows: no rows;
    * other columns are ignored, whatever their names.
    """
    number = docs[row_col] if row_col else F.monotonically_increasing_id()
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), number.alias("row"), fingerprints(docs[f"`{text_col}`"]).alias("fp"))
    rows = written(rows, "fingerprints")
    leasts = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    with WorkTables(docs.sparkSession) as work:
        roots = components(near_links(leasts.select("fp")), work)
        named_roots = leasts.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
        roots = written(named_roots.select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(roots.join(ids, "root"), "fp").select("doc_id", "row", "fp", "component_id", "root")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the least id, the first of equal ones.

    All columns stay, whatever their names.  Rows are numbered in a written copy, so that shuffled
    input or executors that come and go cannot give a row another number.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), whole), "numbered")
    texts = rows.select("row", rows["doc"][id_col].alias("id"), rows["doc"][text_col].alias("text"))
    found = with_components(texts, "id", "text", "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = found.groupBy("root").agg(first.getField("row").alias("row"))
    return rows.join(kept.select("row"), "row", "left_semi").select("doc.*")
