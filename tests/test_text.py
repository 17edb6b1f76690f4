"""Normalisers and splitters against fixtures and Python's own Unicode tables."""

import unicodedata

import pytest
from pyspark.sql import functions as F
from test_training import texts

from glyphmill.fixed import SPECIAL_TOKENS
from glyphmill.functions import normalize, pieces, symbols
from glyphmill.model import BYTE_LEVEL
from glyphmill.operators.counts import char_alphabet, piece_counts

SAMPLES = [
    "café é ﬁ ½ नि", "é", "", "plain", "\x00a\x00", "한국어 각", "Å Å Ä ǆ ①", "\U0001F600 \U0001D400",
    "ά ΐ", "q̣̇", "が ガ ｶﾞ", "שּׁ",
]


def applied(spark, fn, rows):
    df = texts(spark, *rows).withColumn("out", fn(F.col("text")))
    return [r.out for r in df.orderBy("doc_id").collect()]


def python_n3(text):
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text.replace("\x00", "")))
    return "".join(c for c in text if unicodedata.category(c) != "Mn")


def test_normalizers_match_python(spark):
    assert applied(spark, normalize.normalize_nfc, SAMPLES) == [unicodedata.normalize("NFC", s) for s in SAMPLES]
    assert applied(spark, normalize.normalize_nfkc, SAMPLES) == [unicodedata.normalize("NFKC", s) for s in SAMPLES]
    assert applied(spark, normalize.normalize_decompose_strip, SAMPLES) == [python_n3(s) for s in SAMPLES]
    want = ["".join(c for c in unicodedata.normalize("NFKC", s) if unicodedata.category(c)[0] != "M") for s in SAMPLES]
    assert applied(spark, normalize.normalize_nfkc_strip, SAMPLES) == want
    assert want[0] == "café é fi 1⁄2 न"


def test_nothing_below_the_shortcut_changes(spark):
    low = ["".join(map(chr, range(1, 0x300)))]
    assert applied(spark, normalize.normalize_nfc, low) == low
    assert all(unicodedata.normalize("NFKC", chr(c)) == chr(c) for c in range(0xA0))
    assert all(unicodedata.normalize("NFD", chr(c)) == chr(c) for c in range(0xC0))


P1 = {
    "Hello World<|im_end|> 你好世界": ["Hello", " ", "World", "<|", "im", "_", "end", "|>", " ", "你好世界"],
    "it's 'Sam’s abc123 don't_x . . \r\n\n  next　全角 a b नमस्ते": [
        "it", "'s", " '", "Sam", "’", "s", " ", "abc123", " ", "don", "'t", "_", "x", " .", " .", " \r\n\n", "  ", "next",
        "　", "全角", " ", "a", " ", "b", " ", "नमस", "्", "त", "े"],
    "a  \n  b -- !!\n\nc": ["a", "  \n", "  ", "b", " --", " !!\n\n", "c"],
    "'ſx 'LL": ["'ſ", "x", " '", "LL"],
    "": [],
}


def test_split_pieces(spark):
    assert applied(spark, pieces.split_pieces, P1) == list(P1.values())


def test_pieces_match_independent_splitter(spark, documents):
    tokenizers = pytest.importorskip("tokenizers")
    # fixed value: the splitting pattern, in its own syntax
    pattern = (
        r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+"""
    )
    split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "isolated")
    spaces = "".join(f"a{chr(c)}b.{chr(c)}{chr(c)}\n" for c in (0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x3000, 0x85, 0x180E, 0x200B, 0xFEFF, 0x1C, 0x0B))
    rows = [*P1, spaces, "I'M we'Ll\t\t x\r\r\n", *(r.text for r in documents.collect())]
    assert applied(spark, pieces.split_pieces, rows) == [[p for p, _ in split.pre_tokenize_str(s)] for s in rows]


def test_nothing_is_lost(spark, documents):
    for split in (pieces.split_pieces, pieces.split_digits):
        lost = documents.where(F.array_join(split(F.col("text")), "") != F.col("text"))
        assert lost.count() == 0


def test_digits(spark):
    assert applied(spark, pieces.split_digits, ["ab12３½Ⅷ c"]) == [["ab", "1", "2", "３", "½", "Ⅷ", " c"]]


def test_byte_symbols(spark):
    assert applied(spark, pieces.byte_symbols, [" é\n", "", "a"]) == [["Ġ", "Ã", "©", "Ċ"], [], ["a"]]
    assert len(set(pieces.VISIBLE)) == 256


def test_special_texts_come_out_first(spark):
    contents = [*SPECIAL_TOKENS, "<think", "a.b"]
    got = applied(
        spark, lambda c: pieces.split_special(c, contents), ["x<think>y<think z", "axba.b", "<|im_end|><|im_end|>", "", "\n<\n"]
    )
    assert got == [["x", "<think>", "y", "<think", " z"], ["axb", "a.b"], ["<|im_end|>"] * 2, [], ["\n<\n"]]
    assert applied(spark, lambda c: pieces.split_special(c, []), ["ab", ""]) == [["ab"], []]


def test_normalising_stops_at_special_texts(spark):
    got = applied(spark, lambda c: pieces.text_pieces(c, "nfc", "pieces", ["<x>"]), ["<x≯é"])
    assert got[0][0] == "<x>" and got[0][-1] == "é"


def test_long_texts_do_not_overflow(spark):
    long = ["=" * 200_000, " " * 200_000 + "x", "ab" * 100_000, "\n" * 100_000, "<" * 100_000 + "<think>"]
    assert ["".join(p) for p in applied(spark, pieces.split_pieces, long)] == long
    got = applied(spark, lambda c: pieces.text_pieces(c, "nfc", "pieces", SPECIAL_TOKENS), long)
    assert ["".join(p) for p in got] == long and got[4][-1] == "<think>"


def test_alphabet_coverage(spark):
    counts = piece_counts(texts(spark, "aaaa bb c"), BYTE_LEVEL)
    whole = [(r.symbol, r.n) for r in char_alphabet(counts, BYTE_LEVEL).orderBy("position").collect()]
    assert whole == [("a", 4), ("b", 2), ("c", 1), ("Ġ", 2)]
    some = [r.symbol for r in char_alphabet(counts, BYTE_LEVEL, 0.6).orderBy("position").collect()]
    assert some == ["a", "b"]


def test_symbols_beyond_the_basic_plane(spark):
    """Ids past 55,000 skip the surrogates and need two code units each."""
    ids = [0, 55_000, 55_039, 55_040, 70_000, 151_935, symbols.MAX_SYMBOLS - 1]
    codes = [symbols.code_char(i) for i in ids]
    assert [symbols.symbol_id(c) for c in codes] == ids and codes == sorted(codes)
    a, b, c = codes[4:]
    df = spark.createDataFrame([(a + b + a + b + c,), (codes[0] + a,)], "syms string")
    pairs = [r.p for r in df.selectExpr(f"{symbols.pairs_sql('syms')} AS p").collect()]
    assert pairs == [[a + b, b + a, a + b, b + c], [codes[0] + a]]
    around = df.selectExpr(f"{symbols.pairs_around_sql('syms', b, c)} AS p").collect()
    assert [r.p for r in around] == [[b + a, b + c], []]
    merged = df.selectExpr(f"{symbols.merged_sql('syms', [(a + b, codes[3]), (codes[3] + c, codes[2])])} AS s").collect()
    assert [r.s for r in merged] == [codes[3] + codes[2], codes[0] + a]
    with pytest.raises(ValueError):
        symbols.code_char(symbols.MAX_SYMBOLS)


def test_long_batches_are_normalised_in_steps():
    """A batch of many long texts never stands as Python strings at once; nulls, empties and slices stay right."""
    import tracemalloc

    import pyarrow as pa

    from glyphmill.functions import steps

    rows = [None, "", "é" * 3_000, "ﬁ’" * 5] * 4_000
    texts = pa.array(rows, pa.string()).slice(1)
    lists = pa.array([None if t is None else [t[:40], None, t[40:90]][:: 2] for t in rows], pa.list_(pa.string())).slice(2)
    tracemalloc.start()
    got = normalize._normal(texts, "NFKC", "NFD")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * steps.STEP_BYTES
    nfd = lambda t: unicodedata.normalize("NFD", unicodedata.normalize("NFKC", t))
    assert got.to_pylist() == [t and nfd(t) for t in rows[1:]]
    own = normalize._form_list("NFC").func(lists)
    assert own.to_pylist() == [x and [unicodedata.normalize("NFC", t) for t in x] for x in lists.to_pylist()]
    for none in (texts.slice(0, 0), pa.nulls(3, pa.string())):
        assert normalize._normal(none, "NFC").equals(none)
