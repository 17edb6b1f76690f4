"""Learning merges by repeated distributed counting.

Each round is one job over the distinct words, which stay packed in rows of about a million
symbols (``functions.packed``); a round finds the words that hold a pair of its batch and looks
at no others.  Two more things keep rounds few and cheap while the merges stay those of
one-at-a-time training:

* Several merges per round.  Going down the ranking, a pair may join the batch while it does
  not end where a chosen pair starts or start where one ends.  Merging a chosen pair (a, b)
  only lowers pairs ending in a or starting in b, and every pair it creates is no more
  frequent than such a pair, which is itself ranked after the batch.
* Counts by difference.  The driver holds exact counts for the pairs ranked above a bound.
  Old pairs never gain occurrences, so pairs below the bound stay below it; a round only
  reports changes to held pairs and the best of the new pairs above the bound.  If there are
  more new ones than the driver holds, the bound rises.  When none is left above the bound,
  the pairs are counted afresh.

``exact=False`` takes many more merges per round: going down the ranking, each pair that meets no
chosen one, to a share of the most frequent one's count.  Counts stay exact; only the order
of merges may differ from one-at-a-time training, where a merge would have made a pair that ranks
above a later one of the same round.

Pairs are ranked, cut by length and limited in Spark, so no more than ``HELD_PAIRS`` beyond the
held ones ever reach the driver, however many are tied.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from glyphmill.fixed import CHAR_VOCAB_SIZE, VOCAB_SIZE
from glyphmill.functions.packed import PACKED, Step, packed_words, pair_changes, pair_code, pair_sums, rebuilt
from glyphmill.functions.pieces import VISIBLE
from glyphmill.functions.symbols import code_char, coded, symbol_id
from glyphmill.model import BYTE_LEVEL, CHARACTERS, BpeModel, Profile
from glyphmill.operators.counts import char_alphabet, piece_counts, symbol_text
from glyphmill.operators.vocabulary import char_model_tables, model_tables
from glyphmill.session import WorkTables, spread

HELD_PAIRS = 4096
PENDING_STEPS = 16
WRITE_EVERY = 12
# Merges that need not be exact: the least count of a round, as a share of its most frequent pair's.
FLOOR_SHARE = 0.5


@dataclass
class MergeState:
    """What the driver knows: tokens by id, merges so far, and the held pair counts.

    ``by_text`` ranks ties by the shorter, then the smaller text, and ``longest`` limits it.
    """

    tokens: list[str]
    ids: dict[str, int]
    by_text: bool = False
    longest: int | None = None
    merges: list[tuple[str, str]] = field(default_factory=list)
    held: dict[str, int] = field(default_factory=dict)
    # The rank of the first pair that is not held; none if all are.
    bound: tuple | None = None
    rounds: int = 0

    def text(self, chars: str) -> str:
        return "".join(self.tokens[symbol_id(c)] for c in chars)

    def rank(self, pair: str, n: int) -> tuple:
        if not self.by_text:
            return (-n, pair)
        text = self.text(pair)
        return (-n, len(text), text, pair)

    def above(self, pair: str, n: int) -> bool:
        return self.bound is None or self.rank(pair, n) < self.bound

    def ranked(self, rows: DataFrame, first: str | None = None) -> DataFrame:
        """New pairs that may be made, in rank order, after all rows that are marked as ``first``.

        The bound is a filter as far as counts tell.
        """
        pair, ahead = F.col("pair"), F.col(first) if first else F.lit(False)
        order = []
        if self.by_text:
            tokens = F.split(F.lit("\n".join(self.tokens)), "\n")
            text = F.concat(*[F.element_at(tokens, half.cast("int") + 1) for half in (F.shiftright(pair, 32), pair.bitwiseAND(F.lit(0xFFFFFFFF)))])
            rows = rows.withColumn("text", text)
            order = [F.length("text"), F.col("text")]
            if self.longest is not None:
                rows = rows.where(ahead | (F.length("text") <= self.longest))
        if self.bound is not None:
            rows = rows.where(ahead | (F.col("n") >= -self.bound[0]))
        return rows.orderBy(ahead.desc(), F.desc("n"), *order, "pair")


def _coded(pair: str) -> int:
    return pair_code(symbol_id(pair[0]), symbol_id(pair[1]))


def _pair(code: int) -> str:
    return code_char(code >> 32) + code_char(code & 0xFFFFFFFF)


def _choose(state: MergeState, room: int, min_frequency: int) -> list[str]:
    """The longest safe batch of pairs in rank order."""
    starts: set[str] = set()
    ends: set[str] = set()
    texts: set[str] = set()
    floor, batch = max(min_frequency, 1), []
    for pair, n in sorted(state.held.items(), key=lambda kv: state.rank(*kv)):
        if n < floor or len(batch) == room or not state.above(pair, n):
            break
        if pair[0] in ends or pair[1] in starts:
            break
        text = state.text(pair)
        repeated = text in state.ids or text in texts
        if repeated and batch:
            break
        batch.append(pair)
        if repeated:
            break
        starts.add(pair[0])
        ends.add(pair[1])
        texts.add(text)
        if pair[0] == pair[1]:
            # Its product may meet itself, at most half as often.
            floor = max(floor, n // 2 + (1 if state.by_text else 0))
    return batch


def _choose_many(state: MergeState, room: int, min_frequency: int) -> list[str]:
    """Down the ranking each pair that meets no chosen one, to a share of the most frequent one's count."""
    starts: set[str] = set()
    ends: set[str] = set()
    texts: set[str] = set()
    floor, batch = max(min_frequency, 1), []
    for pair, n in sorted(state.held.items(), key=lambda kv: state.rank(*kv)):
        if n < floor or len(batch) == room or not state.above(pair, n):
            break
        text = state.text(pair)
        repeated = text in state.ids or text in texts
        meets = pair[0] in ends or pair[1] in starts or (pair[0] == pair[1] and (pair[0] in starts or pair[1] in ends))
        if repeated and not batch:
            return [pair]
        if meets or repeated:
            continue
        batch.append(pair)
        starts.add(pair[0])
        ends.add(pair[1])
        texts.add(text)
        floor = max(floor, math.ceil(FLOOR_SHARE * state.held[batch[0]]))
    return batch


def _recount(words: DataFrame, pending: list[Step], state: MergeState, min_frequency: int) -> None:
    state.bound = None
    sums = words.mapInArrow(pair_sums(pending), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = state.ranked(sums.where(F.col("n") >= max(min_frequency, 1))).limit(HELD_PAIRS + 1).collect()
    pairs = [(_pair(r.pair), r.n) for r in rows]
    state.held = dict(pairs[:HELD_PAIRS])
    if len(pairs) > HELD_PAIRS:
        state.bound = state.rank(*pairs[-1])


def _changes(words: DataFrame, pending: list[Step], step: Step, touched: list[str], state: MergeState) -> tuple[list, list]:
    """Net pair counts after a step: all held pairs it touches, and the best new pairs above the bound."""
    held = np.sort(np.array([_coded(p) for p in touched], np.int64))
    rows = words.mapInArrow(pair_changes(pending, step, held), "pair long, n long, known boolean")
    sums = rows.groupBy("pair", "known").agg(F.sum("n").alias("n")).where("n != 0 AND (known OR n > 0)")
    found = state.ranked(sums, "known").limit(len(touched) + HELD_PAIRS + 1).collect()
    new = [(p, n) for p, n in ((_pair(r.pair), r.n) for r in found if not r.known) if state.above(p, n)]
    return [(_pair(r.pair), r.n) for r in found if r.known], new


def _take_in(known: list, new: list, state: MergeState) -> None:
    for pair, n in known:
        state.held[pair] += n
    state.held.update(new[:HELD_PAIRS])
    if len(new) > HELD_PAIRS:
        # What was left out ranks from here on; held pairs below that are no longer known to be next.
        state.bound = state.rank(*new[HELD_PAIRS])
        state.held = {p: n for p, n in state.held.items() if state.above(p, n)}


def learn_merges(
    words: DataFrame,
    state: MergeState,
    room: int,
    work: WorkTables,
    min_frequency: int = 1,
    exact: bool = True,
) -> list[tuple[str, str]]:
    """Up to ``room`` new tokens over coded words (syms, n).

    Merges not yet built into the table are applied on the fly; the table is rebuilt when they
    pile up, and written to the shared folder every few rebuilds so that a lost executor
    costs a short replay.
    """
    rows = spread(words.select("syms", "n")).mapInArrow(packed_words, PACKED)
    tables = [rows.persist(StorageLevel.MEMORY_AND_DISK)]
    try:
        return _learn(tables, state, room, work, min_frequency, exact)
    finally:
        for table in tables:
            table.unpersist()


def _learn(tables: list[DataFrame], state: MergeState, room: int, work: WorkTables, min_frequency: int, exact: bool) -> list[tuple[str, str]]:
    words, pending, rebuilds, made = tables[0], [], 0, 0
    choose = _choose if exact else _choose_many
    _recount(words, [], state, min_frequency)
    while made < room:
        batch = choose(state, room - made, min_frequency)
        if not batch:
            if state.bound is None or -state.bound[0] < max(min_frequency, 1):
                break
            _recount(words, pending, state, min_frequency)
            if not choose(state, 1, min_frequency):
                break
            continue
        steps, reused = [], False
        for pair in batch:
            text = state.text(pair)
            if text in state.ids:
                reused = True
            else:
                state.ids[text] = len(state.tokens)
                state.tokens.append(text)
                made += 1
            steps.append((pair, code_char(state.ids[text])))
        state.rounds += 1
        state.merges.extend(steps)
        step = Step.of([(symbol_id(p[0]), symbol_id(p[1]), symbol_id(c)) for p, c in steps])
        if made < room and not reused:
            starts, ends = {p[0] for p in batch}, {p[1] for p in batch}
            touched = [p for p in state.held if p[1] in starts or p[0] in ends]
            _take_in(*_changes(words, pending, step, touched, state), state)
            for pair in batch:
                state.held.pop(pair, None)
            _trim(state)
        pending.append(step)
        if len(pending) >= PENDING_STEPS:
            rebuilds += 1
            # A word that is one symbol has no pair left to give.
            table = words.mapInArrow(rebuilt(pending), PACKED)
            if rebuilds % WRITE_EVERY == 0:
                table = work.write(table, "words")
                if len(work.paths) > 2:
                    work.drop()
            # Filled by the next round; the table before it stays until then.
            tables.append(table.persist(StorageLevel.MEMORY_AND_DISK))
            words, pending = table, []
        elif len(tables) > 1:
            tables.pop(0).unpersist()
        if reused:
            _recount(words, pending, state, min_frequency)
    return state.merges


def _trim(state: MergeState) -> None:
    """Forget exhausted pairs and, when too many are held, the lowest ranked ones."""
    state.held = {p: n for p, n in state.held.items() if n > 0}
    if len(state.held) > 4 * HELD_PAIRS:
        ranked = sorted(state.held.items(), key=lambda kv: state.rank(*kv))
        state.bound = min(filter(None, (state.bound, state.rank(*ranked[2 * HELD_PAIRS]))))
        state.held = dict(ranked[: 2 * HELD_PAIRS])


def coded_words(pieces: DataFrame, profile: Profile, symbols: Sequence[str], ids: Sequence[int]) -> DataFrame:
    """(syms, n): distinct pieces of two or more symbols, coded by symbol id."""
    words = pieces.select(coded(symbol_text(F.col("piece"), profile), symbols, ids).alias("syms"), "n")
    return words.where(F.length("syms") > 1)


def train_bpe(
    df: DataFrame,
    vocab_size: int | None = VOCAB_SIZE,
    min_frequency: int = 1,
    profile: Profile = BYTE_LEVEL,
    text: str = "text",
    max_merges: int | None = None,
    exact: bool = True,
) -> BpeModel:
    """Byte-level BPE: specials first, then the alphabet by code point, then merges in order.

    ``max_merges`` limits the learned tokens instead of the vocabulary as a whole.  Without
    ``exact``, merges of similar counts may come in another order, in far fewer rounds.
    """
    with WorkTables(df.sparkSession) as work:
        pieces = work.write(piece_counts(df, profile, text), "pieces")
        seen = [r.symbol for r in char_alphabet(pieces, profile).collect()]
        alphabet = sorted(VISIBLE) if profile.full_byte_alphabet else sorted(seen)
        tokens = list(dict.fromkeys([*profile.specials, *alphabet]))
        ids = {t: i for i, t in enumerate(tokens)}
        state = MergeState(tokens, ids)
        words = coded_words(pieces, profile, alphabet, [ids[s] for s in alphabet])
        room = vocab_size - len(tokens) if max_merges is None else max_merges
        learn_merges(words, state, room, work, min_frequency, exact)
    return model_tables(df.sparkSession, state, profile, alphabet)


def retrain_like(
    model: BpeModel, df: DataFrame, vocab_size: int | None, text: str = "text", max_merges: int | None = None, exact: bool = True
) -> BpeModel:
    """A new vocabulary from another corpus with an existing model's normaliser, splitter and specials."""
    return train_bpe(df, vocab_size, 0, model.profile, text, max_merges, exact)


def train_char_bpe(
    df: DataFrame,
    vocab_size: int | None = CHAR_VOCAB_SIZE,
    profile: Profile = CHARACTERS,
    text: str = "text",
    coverage: float = 1.0,
    max_merges: int | None = None,
    exact: bool = True,
) -> BpeModel:
    """Character BPE: unknown token, user symbols, 256 byte tokens, merges, then characters.

    Ties go to the shorter, then the lexically smaller piece; pieces longer than the
    profile's limit are never made.
    """
    # Lines are the training sentences, so no piece spans a line break.
    lines = df.select(F.explode(F.split(F.col(text), r"\n")).alias(text))
    with WorkTables(df.sparkSession) as work:
        pieces = work.write(piece_counts(lines, profile, text), "pieces")
        rows = char_alphabet(pieces, profile, coverage).collect()
        chars = [r.symbol for r in sorted(rows, key=lambda r: (-r.n, r.symbol))]
        room = vocab_size - 1 - len(profile.specials) - 256 - len(chars) if max_merges is None else max_merges
        if room < 0:
            raise ValueError("vocab_size is smaller than the characters, byte tokens and user symbols need")
        state = MergeState(list(chars), {c: i for i, c in enumerate(chars)}, True, profile.max_piece)
        words = coded_words(pieces, profile, chars, range(len(chars)))
        learn_merges(words, state, room, work, exact=exact)
    return char_model_tables(df.sparkSession, state, profile, chars)
