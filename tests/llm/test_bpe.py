import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from glyphmill.llm import bpe
from glyphmill.llm.queries import op12_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def judge():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])]


def test_the_hash_is_perfect_and_minimal():
    for n in (1, 2, 3, 10, 1000, 20_000):
        keys = [f"key {k}".encode() for k in range(n)]
        table = bpe.perfect_hash(keys)
        assert sorted(table.places(bpe.hashes(keys, table.seed))) == list(range(n))
    with pytest.raises(ValueError):
        bpe.perfect_hash([b"twice", b"twice"])


def test_equals_the_public_encoder(vocabulary, judge):
    texts = [
        "",
        "Hello world, it's 12345 o'clock",
        "  two  spaces   and\n\n lines \t\r\n",
        "über naïve façade 日本語 नमस्ते ✨ <|endoftext|>",
        "a" * 3000,
        "ab" * 2500 + "\x00\x1c\x85   x",
        "՘֋ x\U000323e7y 1\U00012475",
        "xyz" * 500 + " " * 500 + "end",
    ]
    assert ids_of(bpe.Encoder(vocabulary), texts) == [judge.encode_ordinary(t) for t in texts]


def test_classes_are_those_of_the_public_encoder(vocabulary):
    """On every code point, for each class of the pattern."""
    single = {bytes([b]): b for b in range(256)}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        other = tiktoken.Encoding("one", pat_str=name, mergeable_ranks=single, special_tokens={})
        exact = bpe.regex.compile(bpe._exact_pattern(name)[1])
        wrong = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and bool(exact.match(chr(p))) != bool(other.encode_ordinary(chr(p)))]
        assert wrong == []


def test_ordinary_texts_take_the_short_pattern(vocabulary):
    encoder = bpe.Encoder(vocabulary)
    assert not encoder.odd.search("äöü ñ 日本語 नमस्ते 123 ½ ✨ АБВ عربى")
    assert encoder.odd.search("՘") and encoder.odd.search("\U000323e7")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(vocabulary, judge, texts):
    assert ids_of(bpe.Encoder(vocabulary), texts) == [judge.encode_ordinary(t) for t in texts]


def test_chunks_and_memo_change_nothing(vocabulary, judge, monkeypatch):
    texts = ["some long text of words und Wörter " * 40, "", "short", "zzqx kkwv " * 50]
    monkeypatch.setattr(bpe, "CHUNK", 64)
    monkeypatch.setattr(bpe, "MEMO", 4)
    assert ids_of(bpe.Encoder(vocabulary), texts) == [judge.encode_ordinary(t) for t in texts]


def test_query_on_whole_documents(spark, sf_small, documents, judge):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    rows = op12_bpe(spark, sf_small).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = judge.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_edges(spark, vocabulary):
    rows = spark.createDataFrame([(1, None, "k"), (1, "same", "k"), (1, "same", None), (None, "", "k")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(rows, vocabulary), vocabulary)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.text or "", len(r.ids), bytes(r.decoded)) for r in out.collect()) == [("", 0, b""), ("", 0, b""), ("same", 8, b"same"), ("same", 8, b"same")]
    none = hashlib.sha256(b"").hexdigest()
    empty = [r for r in bpe.digests(rows, vocabulary).collect() if r.n_tokens == 0]
    assert [(r.ids_sha256, r.decoded_sha256) for r in empty] == [(none, none)] * 2
    assert bpe.digests(rows.limit(0), vocabulary).count() == 0


def test_ids_outside_the_vocabulary_are_an_error(vocabulary):
    with pytest.raises(pa.lib.ArrowIndexError):
        list(bpe.decoded_chunks(np.array([60_000], "<u4").tobytes(), pa.array(vocabulary.tokens, pa.large_binary())))
