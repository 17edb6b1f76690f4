import tracemalloc

import pytest
from pyspark.sql import functions as F
from test_training import TINY, reference_merges, texts

from glyphmill.fixed import SPECIAL_TOKENS
from glyphmill.functions import merging, steps
from glyphmill.functions.merging import merge_symbols
from glyphmill.model import Profile
from glyphmill.operators.codec import (
    _encoder,
    _tables,
    build_training_rows,
    compare_vocab,
    decode,
    dropped_symbols,
    encode,
    fixed_rows,
    roundtrip_check,
    tokenize,
)
from glyphmill.operators.training import train_bpe
from glyphmill.operators.vocabulary import add_tokens


@pytest.fixture(scope="module")
def tiny(spark):
    return train_bpe(texts(spark, "abab abab cd cd ef"), 100, 1, TINY)


def ids(df):
    return [r.input_ids for r in df.orderBy("doc_id").collect()]


def test_unseen_bytes_vanish(spark, tiny):
    df = texts(spark, "abz ab é<|endoftext|>cd", "", "zz")
    assert ids(encode(df, tiny)) == [[9, 8, 9, 8, 0, 10], [], []]
    rows = encode(df, tiny).limit(1)
    assert decode(rows, tiny, out="t").first().t == "ab ab <|endoftext|>cd"
    assert decode(rows, tiny, out="t", skip_special=True).first().t == "ab ab cd"
    assert {r.symbol: r.n for r in dropped_symbols(df, tiny).collect()} == {"z": 3, "Ã": 1, "©": 1}


def test_neighbours_of_a_vanished_byte_meet(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer(tokenizers.models.BPE(vocab={"a": 0, "b": 1, "ab": 2}, merges=[("a", "b")]))
    assert tok.encode("azb").ids == [2]
    model = train_bpe(texts(spark, "ab"), 100, 1, Profile("p", specials=()))
    assert ids(encode(texts(spark, "azb"), model)) == [[2]]


def test_fixed_length_rows(spark, tiny):
    rows = fixed_rows(encode(texts(spark, "ab cd ef ab", "ab"), tiny), 6, 0).orderBy("doc_id").collect()
    assert rows[1].input_ids == [9, 0, 0, 0, 0, 0] and rows[1].attention_mask == [1, 0, 0, 0, 0, 0]
    cut = build_training_rows(texts(spark, "ab cd ef ab", "ab"), tiny, 4).orderBy("doc_id").collect()
    assert cut[0].input_ids == [9, 8, 10, 8] and cut[0].attention_mask == [1] * 4
    assert cut[1].input_ids == [9, 0, 0, 0] and cut[1].attention_mask == [1, 0, 0, 0]
    assert list(cut[0].asDict()) == ["doc_id", "input_ids", "attention_mask", "token_type_ids"]
    assert all(row.token_type_ids == [0] * 4 for row in cut)


def test_lowest_rank_first():
    ranks = {("abc", "d"): (0, "abcd"), ("b", "c"): (1, "bc"), ("a", "bc"): (2, "abc")}
    assert merge_symbols(list("abcd"), ranks.get) == ["abcd"]


def test_overlap(spark):
    profile = Profile("whole", splitter="none", specials=())
    model = train_bpe(texts(spark, *["aaaa aaa"] * 3), 100, 1, profile)
    assert tokenize(texts(spark, "aaaaa"), model).first().tokens == ["aaaa", "a"]


def test_special_text_is_trained_on_but_encoded_whole(spark):
    profile = Profile("t", specials=("<think>",))
    model = train_bpe(texts(spark, "xx<think>yy"), 60, 1, profile)
    got = tokenize(texts(spark, "xx<think>y y"), model).first().tokens
    assert got[:3] == ["xx", "<think>", "y"]


def test_matches_independent_encoder(spark, documents):
    rows = [r.text for r in documents.orderBy("doc_id").collect()]
    _, tok = reference_merges(rows, SPECIAL_TOKENS, 300)
    model = train_bpe(documents, 300)
    extra = ["it's <|im_end|>'Sam’s abc123 \r\n\n  next　全角 नमस्ते é <think>x</think>", "<|im_end|><|im_end|>", "\n\n"]
    df = documents.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    want = [e.ids for e in tok.encode_batch(rows + extra, add_special_tokens=False)]
    assert ids(encode(df, model)) == want
    tokens = [r.tokens for r in tokenize(df, model).orderBy("doc_id").collect()]
    assert tokens == [e.tokens for e in tok.encode_batch(rows + extra, add_special_tokens=False)]


def test_roundtrip_over_the_full_byte_alphabet(spark, documents):
    model = train_bpe(documents, 320, profile=Profile("full", full_byte_alphabet=True))
    extra = texts(spark, "é \U0001F600 नि \x00 \r\n", "").withColumn("doc_id", F.col("doc_id") + 10**6)
    df = documents.select("doc_id", "text").union(extra)
    assert roundtrip_check(df, model).where("not same").count() == 0


def test_invalid_bytes_are_replaced(spark, documents):
    model = train_bpe(documents.limit(5), 300, profile=Profile("full", specials=(), full_byte_alphabet=True))
    high = {int(r.token_hex, 16): r.token_id for r in model.vocab.where("kind = 'byte'").collect()}
    raws = [b"\xff", b"a\xc3", b"\xe4\xbd", b"\xf0\x9f\x98\x80\x80", b"\xed\xa0\x80"]
    df = spark.createDataFrame([(i, [high[b] for b in raw]) for i, raw in enumerate(raws)], "i int, input_ids array<int>")
    assert [r.t for r in decode(df, model, out="t").orderBy("i").collect()] == [r.decode("utf-8", "replace") for r in raws]


def test_added_tokens_match_whole(spark, tiny):
    model = add_tokens(tiny, ["<ACTION_1>", "<ACTION_2>", "ab"])
    got = tokenize(texts(spark, "cd<ACTION_1>ab"), model).first().tokens
    assert got == ["cd", "<ACTION_1>", "ab"]
    assert ids(encode(texts(spark, "<ACTION_1><ACTION_2>"), model)) == [[13, 14]]


def test_compare(spark, tiny, documents):
    other = train_bpe(texts(spark, "ab cd"), 100, 1, TINY)
    row = compare_vocab(tiny, other, texts(spark, "abab")).first()
    assert row.first_tokens == ["abab"] and row.second_tokens == ["ab", "ab"]


def test_nulls_stay_null(spark, tiny):
    df = spark.createDataFrame([(0, None), (1, "ab")], "doc_id long, text string")
    assert ids(encode(df, tiny)) == [None, [9]]


def test_memo_turnover_changes_nothing(spark, documents, monkeypatch):
    import pyarrow as pa

    from glyphmill.functions import merging

    ranks = {(97, 98): (0, 256), (256, 256): (1, 257)}
    tables = {"symbols": "bytes", "fixed": {"<s>": 999}, "memo": {}, "older": {}, "byte_ids": list(range(256)), "ranks": ranks}
    rows = [["abab", "<s>", "a"], None, [], ["abab", "x" * 100, "ab"]]
    first = merging.batch_ids(pa.array(rows, pa.list_(pa.string())), tables).to_pylist()
    assert first == [[257, 999, 97], None, [], [257, *[120] * 100, 256]]
    monkeypatch.setattr(merging, "MEMO_PIECES", 1)
    sliced = pa.array([["zz"], *rows], pa.list_(pa.string())).slice(1)
    for _ in range(3):
        assert merging.batch_ids(sliced, tables).to_pylist() == first


def test_long_batches_are_laid_out_in_steps(spark, tiny):
    """One batch of many long texts takes memory for a step, not for the batch."""
    pa = pytest.importorskip("pyarrow")
    rows = [["ab", " ", "cd", "é", " ", "ef"] * 100, None, [], ["abab"]] * 6_000
    batch = pa.array(rows, pa.list_(pa.string())).slice(1)
    _, to_ids = _encoder(tiny)
    tables, got, peak = _tables(tiny), [], 0
    tracemalloc.start()
    for part in to_ids.func(iter([batch, batch.slice(0, 0)])):
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        got.append(part)
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert peak < 50 * steps.STEP_BYTES
    assert pa.concat_arrays(got).to_pylist() == merging.batch_ids(batch, tables).to_pylist()
    assert len(got) > 2


def test_tokens_are_looked_up_as_they_are(spark):
    """Token strings stand in the constant table; none is decoded for every position of a text."""
    profile = Profile("s", specials=(",|", "é,"))
    model = train_bpe(texts(spark, "ab ab, x"), 100, 1, profile)
    rows = tokenize(texts(spark, "ab, é,,|x"), model)
    assert rows.first().tokens == ["ab", ",", "Ġ", "é,", ",|", "x"]
    both = compare_vocab(model, model, texts(spark, "é,ab"))
    assert both.first().first_tokens == both.first().second_tokens == ["é,", "ab"]
    for df in (rows, both):
        assert "unhex" not in df._jdf.queryExecution().optimizedPlan().toString()
