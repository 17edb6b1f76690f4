"""Toxicity by multiple-instance learning.

Only documents carry labels.  A sentence is toxic with probability ``sigmoid(leak + sum of its
words' weights)``, a document if any of its sentences is (noisy-or), and the weights are those
that make the documents' labels likely.  Trained so, the sentence scores say where in a
document the offence stands.

The fit takes a bounded sample, ``MOST_PER_CLASS`` labelled documents of each class, chosen by
a hash of their ids; only hashed word features of these reach the driver.  Scoring reads every
text as a whole, in one pass and without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from glyphmill.llm.common import named

# Words are runs of letters; a sentence ends at a stop, a mark or a line's end.
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = ".!?\n"
FEATURES = 1 << 20
PREFIXES = (4, 5, 6)
MOST_PER_CLASS = 3000
# A feature counts from this many documents on, if its rates in the two classes are this many
# standard errors and this factor apart.
LEAST_DOCS, LEAST_Z, LEAST_RATIO = 3, 3.0, 8.0
ROUNDS, RATE, SHRINK = 150, 0.5, 1e-6
# Log odds of a sentence without any sign.  Fixed, not fitted, so that length alone condemns no text.
LEAK = -14.0
# Characters of text that one step of the scoring holds.
STEP = 4 << 20


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    parts = [f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n]
    return [zlib.crc32(p.encode()) % FEATURES for p in (f"w:{word}", *parts)]


@dataclass
class Tokens:
    """Words of several texts: code of each word, its sentence, and each sentence's text."""

    vocabulary: list[str]
    codes: np.ndarray
    sentence: np.ndarray
    text_of: np.ndarray
    texts: int


def tokens_of(texts: list[str]) -> Tokens:
    flat: list[str] = []
    counts = np.empty(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        before = len(flat)
        flat += _TOKEN.findall(text.lower())
        flat.append("\n")
        counts[k] = len(flat) - before
    coded = pa.array(flat, pa.string()).dictionary_encode()
    vocabulary, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    ends = np.fromiter((w in _ENDS for w in vocabulary), dtype=bool, count=len(vocabulary))[codes]
    sentence = (np.cumsum(ends) - ends)[~ends]
    # Number the sentences that have words.
    kept, sentence = np.unique(sentence, return_inverse=True)
    text_of = np.repeat(np.arange(len(texts)), counts)[ends][kept]
    return Tokens(vocabulary, codes[~ends], sentence, text_of, len(texts))


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def word_weight(self, word: str) -> float:
        return 0.0 if word in _ENDS else float(self.weights[word_features(word)].sum())

    def sentence_scores(self, tokens: Tokens) -> np.ndarray:
        by_word = np.fromiter(map(self.word_weight, tokens.vocabulary), dtype=np.float64, count=len(tokens.vocabulary))
        return self.bias + np.bincount(tokens.sentence, by_word[tokens.codes], len(tokens.text_of))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Noisy-or of the sentences of each text; 0 without words."""
        tokens = tokens_of(texts)
        clean = -np.logaddexp(0.0, self.sentence_scores(tokens))
        return -np.expm1(np.bincount(tokens.text_of, clean, tokens.texts))

    def offences(self, text: str, least: float = 0.5) -> list[dict]:
        """Sentences of at least that score: start and end in characters, and the score."""
        out, start, end, total = [], None, 0, 0.0
        for m in [*_TOKEN.finditer(text), None]:
            if m is not None and m[0] not in _ENDS:
                start, end = m.start() if start is None else start, m.end()
                total += sum(self.word_weight(w) for w in _TOKEN.findall(m[0].lower()))
            elif start is not None:
                score = 1.0 / (1.0 + np.exp(-(self.bias + total)))
                if score >= least:
                    out.append({"start": start, "end": end, "score": float(score)})
                start, total = None, 0.0
        return out


def _sample(docs: DataFrame, labels: DataFrame, most: int, seed: int) -> DataFrame:
    """``text, toxic, weight``: at most about ``most`` documents of each class; weight undoes the choice.

    Both tables are cut by the same hash of the id before they meet, so the join moves no more than the sample.
    """
    counts = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, most / max(1, n)) for k, n in counts.items()}

    def at(key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    wanted = F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    chosen = labels.where(at("doc_id") < wanted).withColumn("weight", 1.0 / wanted)
    near = docs.where(at("doc_id") < max(share.values(), default=1.0))
    return near.join(chosen, "doc_id").select("doc_id", "text", "toxic", "weight")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as sentences of hashed features: two int32 columns packed as bytes."""
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            t = tokens_of([text or ""])
            own = [word_features(w) if w not in _ENDS else [] for w in t.vocabulary]
            sizes = np.array([len(x) for x in own], dtype=np.int64)[t.codes]
            flat = np.array([f for c in t.codes.tolist() for f in own[c]], dtype="<i4")
            pairs = np.unique(np.stack([np.repeat(t.sentence, sizes).astype("<i4"), flat], axis=1), axis=0) if len(flat) else np.empty((0, 2), "<i4")
            rows.append((pairs[:, 0].astype("<i4").tobytes(), pairs[:, 1].astype("<i4").tobytes(), len(t.text_of)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int64()))]],
            ["toxic", "weight", "sentences", "features", "n"],
        )


def train(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the documents that have a label.

    Null ids or labels do not count; of several labels of an id the largest holds; repeated
    documents count as often as they occur; without any toxic example nothing is toxic.
    """
    known = named(labels, doc_id=id_col, toxic=label_col).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = _sample(named(docs, doc_id=id_col, text=text_col), known, most_per_class, seed)
    found = sample.select("text", "toxic", "weight").mapInArrow(
        _features, "toxic int, weight double, sentences binary, features binary, n long"
    )
    # The packed features stay where they arrived; rows only point to them.
    names = ("toxic", "weight", "n", "sentences", "features")
    rows = zip(*(found.toArrow().select(names).columns))
    return fit([dict(zip(names, (*(x.as_py() for x in r[:3]), *(x.as_buffer() for x in r[3:])))) for r in rows])


def fit(rows: list[dict]) -> ToxicityModel:
    """Maximise the weighted likelihood of the labels by adaptive gradient steps."""
    model = ToxicityModel(np.zeros(FEATURES, dtype=np.float32), LEAK)
    toxic = np.array([r["toxic"] for r in rows], dtype=bool)
    if not toxic.any():
        return model
    # The order of rows does not matter but for rounding; fix it all the same.
    rows = sorted(rows, key=lambda r: (r["toxic"], r["n"], zlib.crc32(r["features"])))
    toxic = np.array([r["toxic"] for r in rows], dtype=bool)
    weight = np.array([r["weight"] for r in rows])
    weight /= weight.mean()
    n = np.array([r["n"] for r in rows], dtype=np.int32)
    # Keep the features whose rates in the two classes clearly differ.
    with_pos, with_neg = np.zeros(FEATURES), np.zeros(FEATURES)
    for r in rows:
        (with_pos if r["toxic"] else with_neg)[np.unique(np.frombuffer(r["features"], "<i4"))] += 1
    n_pos, n_neg = toxic.sum(), max(1, (~toxic).sum())
    rate = (with_pos + with_neg) / len(rows)
    apart = with_pos / n_pos - with_neg / n_neg
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n_pos + 1 / n_neg))
    odds = np.log((with_pos + 0.1) / (n_pos + 0.2)) - np.log((with_neg + 0.1) / (n_neg + 0.2))
    useful = (with_pos + with_neg >= LEAST_DOCS) & (apart >= LEAST_Z * error) & (odds >= np.log(LEAST_RATIO))
    features, sentences = [], []
    for r, first in zip(rows, np.cumsum(n) - n):
        own = np.frombuffer(r["features"], "<i4")
        keep = useful[own]
        features.append(own[keep])
        sentences.append(np.frombuffer(r["sentences"], "<i4")[keep] + first)
    feature, sentence = np.concatenate(features), np.concatenate(sentences)
    w = np.where(useful, 2 * odds, 0.0)
    doc_of = np.repeat(np.arange(len(rows)), n)
    seen = np.full(FEATURES, 1e-8)
    for _ in range(ROUNDS):
        z = LEAK + np.bincount(sentence, w[feature], len(doc_of))
        p = 1.0 / (1.0 + np.exp(-z))
        clean = np.bincount(doc_of, -np.logaddexp(0.0, z), len(rows))
        # d log P(label) / dz of a sentence: -p if clean, p (1 - P) / P if toxic.
        pull = np.where(toxic, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), -1.0) * weight
        slope = p * pull[doc_of]
        g = np.bincount(feature, slope[sentence], FEATURES) - SHRINK * len(rows) * w
        seen += g * g
        w += np.where(useful, RATE * g / np.sqrt(seen), 0.0)
    return ToxicityModel(w.astype(np.float32), LEAK)


FOUND = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "offences",
            T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])),
        ),
    ]
)


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "_toxic", spans: bool = True) -> DataFrame:
    """``docs`` with a struct of the text's score and its offending sentences (only where the score is at least 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            sizes = np.cumsum([len(t) for t in texts]) // STEP if texts else np.empty(0)
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
            scores = np.concatenate([own.scores(texts[a:b]) for a, b in zip(cuts, cuts[1:])]) if texts else np.empty(0)
            yield pa.array(
                [{"score": float(s), "offences": own.offences(t) if spans and s >= 0.5 else []} for s, t in zip(scores, texts)], to_arrow_type(FOUND)
            )

    # Declared so that it runs once per row, not once for a filter and once for the columns.
    return docs.withColumn(out, found.asNondeterministic()(F.col(f"`{text}`")))


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, offences`` per row.

    Null and empty texts, and texts without letters, score 0; repeated rows each get their row;
    no rows give no rows; other columns are ignored, whatever their names.
    """
    return scored(named(docs, doc_id=id_col, text=text_col), model).select("doc_id", "_toxic.score", "_toxic.offences")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; the columns stay."""
    return scored(docs, model, text_col, spans=False).where(F.col("_toxic.score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
