"""Character BPE: layout, encoding, and the same merges as an independent trainer."""

import io

import pytest
from test_training import texts

from glyphmill.operators.codec import encode, roundtrip_check, tokenize
from glyphmill.operators.training import train_char_bpe
from glyphmill.operators.vocabulary import expand_vocab

SPECIALS = ["<|endoftext|>", "<|im_start|>", "<|im_end|>"]
ROWS = [
    "the cat sat on the mat 12 times, the end.", "  two spaces then text", "abcabc abcabd x1y2", "Привет мир, hello мир",
    "今日は良い天気 hello", "repeat repeat repeat-repeat", "line one\nline two the", "<|im_start|>the user",
    "😀😀 😀😀 𝐀𝐁", "ߊߋߌ!ߊߋߌ! ߊߋߌ", "ⴰⴱⴳ!ⴰⴱⴳ ⴰⴱ!", "ꀀꀁ.ꀀꀁ. ꀀ",
]


@pytest.fixture(scope="module")
def model(spark):
    return train_char_bpe(texts(spark, *ROWS), None, max_merges=40)


def test_layout(model):
    rows = model.vocab.orderBy("token_id").collect()
    assert [r.token for r in rows[:4]] == ["<unk>", *SPECIALS]
    assert rows[4].token == "<0x00>" and rows[259].token == "<0xFF>"
    assert [r.score for r in rows[260:]] == [-float(i) for i in range(len(rows) - 260)]
    assert [r.kind for r in rows[260:300]] == ["merge"] * 40 and {r.kind for r in rows[300:]} == {"char"}
    assert all(len(r.merged) <= 32 and "▁" not in r.merged[1:] for r in model.merges.collect())


def test_byte_fallback_digits_and_user_symbols(spark, model):
    got = tokenize(texts(spark, "é12<|im_end|>"), model).first().tokens
    assert got == ["<0xC3>", "<0xA9>", "1", "2", "<|im_end|>"]
    assert roundtrip_check(texts(spark, *ROWS, "é \U0001F600  ", ""), model).where("not same").count() == 0


def test_matches_independent_trainer(spark, model):
    spm = pytest.importorskip("sentencepiece")
    size = model.vocab.count()
    out = io.BytesIO()
    lines = [line for row in ROWS for line in row.split("\n")]
    # fixed values: the trainer's options decide the merges
    spm.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_writer=out, vocab_size=size, model_type="bpe", character_coverage=1.0,
        pad_id=-1, bos_id=-1, eos_id=-1, unk_id=0, user_defined_symbols=SPECIALS, split_digits=True, byte_fallback=True,
        remove_extra_whitespaces=False, add_dummy_prefix=False, normalization_rule_name="identity",
        max_sentencepiece_length=32, minloglevel=2,
    )
    sp = spm.SentencePieceProcessor(model_proto=out.getvalue())
    ours = [r.token for r in model.vocab.orderBy("token_id").collect()]
    theirs = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    assert ours == theirs
    rows = [*lines, "the catalogue é 7", "of  a  b"]
    got = [r.input_ids for r in encode(texts(spark, *rows), model).orderBy("doc_id").collect()]
    assert got == [sp.encode(r) for r in rows]


def test_appended_pieces_join_across_words(spark, model):
    """A piece appended with score 0 ranks above every learned one, and may hold a space."""
    wider = model.with_tables(vocab=expand_vocab(model.vocab, ["t▁o"]))
    base = tokenize(texts(spark, "the xt on"), model).first().tokens
    got = tokenize(texts(spark, "the xt on"), wider).first().tokens
    assert "t▁o" in got and "t▁o" not in base and "".join(got) == "".join(base)
