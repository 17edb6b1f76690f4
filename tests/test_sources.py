import json
import os

import pytest
from pyspark.sql import functions as F

from glyphmill.model import BYTE_LEVEL
from glyphmill.operators.codec import build_training_rows
from glyphmill.operators.counts import piece_counts
from glyphmill.operators.training import train_bpe
from glyphmill.operators.vocabulary import load_vocab, pad_id, save_vocab, special_tokens_map, vocab_size
from glyphmill.sources import readers, writers
from glyphmill.streaming import corpus

TRICKY = ["plain", 'quo"te, comma', "two\nlines", "  spaced　", "ünï 全角", "\\slash\\"]


def values(df, column="text"):
    return sorted(r[column] for r in df.collect())


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_jsonl_policies(spark, tmp_path):
    good = "".join(json.dumps({"text": t, "other": 1}) + "\n" for t in TRICKY)
    missing = put(f"{tmp_path}/m/a.jsonl", good + '{"other": 1}\n')
    broken = put(f"{tmp_path}/b/a.jsonl", good + '{"text": "cut\n{"other": 2}\n')
    assert values(readers.read_jsonl(spark, put(f"{tmp_path}/g/a.jsonl", good))) == sorted(TRICKY)
    with pytest.raises(Exception, match="without text"):
        readers.read_jsonl(spark, missing).collect()
    assert values(readers.read_jsonl(spark, missing, "present")) == sorted(TRICKY)
    with pytest.raises(Exception):
        readers.read_jsonl(spark, broken, "present").collect()
    assert values(readers.read_jsonl(spark, broken, "skip")) == sorted(TRICKY)
    assert [r.line for r in readers.bad_lines(spark, broken).collect()] == ['{"text": "cut']


def test_text_lines(spark, tmp_path):
    path = put(f"{tmp_path}/a.txt", " a 　\n\n\x1cb\x1f\nlast")
    assert [r.text for r in readers.read_text(spark, path).collect()] == [" a 　", "", "\x1cb\x1f", "last"]
    assert [r.text for r in readers.read_text(spark, path, strip=True).collect()] == ["a", "", "b", "last"]


def test_json_array(spark, tmp_path):
    path = put(f"{tmp_path}/a.json", json.dumps([{"completion": t, "x": 1} for t in TRICKY], ensure_ascii=False, indent=1))
    assert values(readers.read_json_array(spark, path)) == sorted(TRICKY)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in TRICKY], "text string")
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{tmp_path}/csv")
    assert values(readers.read_csv(spark, f"{tmp_path}/csv")) == sorted(TRICKY)
    with pytest.raises(ValueError, match="body"):
        readers.read_csv(spark, put(f"{tmp_path}/no/a.csv", "body\nx\n"))


def test_mixed_corpus(spark, tmp_path):
    root = f"{tmp_path}/corpus"
    put(f"{root}/a.jsonl", '{"text": "one"}\n')
    put(f"{root}/b.txt", "two\nthree\n")
    put(f"{root}/b2.text", "four\n")
    put(f"{root}/c.json", '[{"text": "five"}]')
    put(f"{root}/d.csv", "id,text\n1,six\n")
    put(f"{root}/e.md", "no\n")
    put(f"{root}/deep/f.jsonl", '{"text": "seven"}\n')
    spark.createDataFrame([("eight", 1)], "text string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    part = next(f for f in os.listdir(f"{tmp_path}/p") if f.endswith(".parquet"))
    os.link(f"{tmp_path}/p/{part}", f"{root}/g.parquet")
    flat = readers.read_corpus(spark, root)
    assert values(flat) == sorted(["one", "two", "three", "four", "five", "six", "eight"])
    assert "seven" in values(readers.read_corpus(spark, root, recursive=True))
    order = [r["format"] for r in readers.discover(spark, root).orderBy("position").collect()]
    assert order == ["jsonl", "parquet", "text", "text", "json", "csv"]
    put(f"{tmp_path}/none/x.md", "")
    with pytest.raises(FileNotFoundError, match="supported"):
        readers.read_corpus(spark, f"{tmp_path}/none")


def test_require_text_names_columns(spark):
    with pytest.raises(ValueError, match="'id'"):
        readers.require_text(spark.range(1))


def test_write_jsonl_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("é", None, "f1"), ("b", 2, "f2")], "text string, n int, file string")
    writers.write_jsonl(df, f"{tmp_path}/j", shard="file")
    folder = f"{tmp_path}/j/shard=f1"
    line = open(f"{folder}/{next(f for f in os.listdir(folder) if f.endswith('.json'))}", encoding="utf-8").read()
    assert line == '{"text":"é","n":null,"file":"f1"}\n'


def test_write_lines(spark, tmp_path):
    writers.write_lines(spark.createDataFrame([("a\nb",), ("c",)], "text string"), "text", f"{tmp_path}/l")
    assert values(readers.read_text(spark, f"{tmp_path}/l")) == ["a", "b", "c"]


def test_bad_files_are_left_out_whole(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = f"{tmp_path}/shards"
    os.makedirs(root)
    for name in ("good", "torn"):
        rows = pa.table({"text": [f"{name} {i} " + "x" * (i % 50) for i in range(20_000)]})
        pq.write_table(rows, f"{root}/{name}.parquet", row_group_size=5_000)
    put(f"{root}/broken.parquet", "not parquet at all")
    with open(f"{root}/torn.parquet", "r+b") as f:
        f.seek(os.path.getsize(f.name) * 2 // 3)
        f.write(b"\xff" * 4_000)
    rows, left_out = readers.read_good_files(spark, root)
    assert sorted(r.source_file for r in left_out.collect()) == ["broken.parquet", "torn.parquet"]
    got = rows.groupBy(F.split("text", " ")[0].alias("name"), "source_file").count().collect()
    assert [tuple(r) for r in got] == [("good", "good.parquet", 20_000)]


def test_model_survives_saving(spark, documents, tmp_path):
    model = train_bpe(documents.limit(20), 150)
    save_vocab(model, f"{tmp_path}/model")
    again = load_vocab(spark, f"{tmp_path}/model")
    assert again.profile == model.profile
    for name in ("vocab", "merges", "added_tokens"):
        assert sorted(getattr(again, name).collect()) == sorted(getattr(model, name).collect())
    assert pad_id(again) == 0 and vocab_size(again).first().vocab_size == 150
    roles = [r.role for r in special_tokens_map(again).collect()]
    assert roles.count("additional_special_tokens") == 13 and {"eos_token", "pad_token"} <= set(roles)


def test_streams_equal_batch(spark, documents, tmp_path):
    docs = documents.select("doc_id", "text").repartition(4)
    docs.write.parquet(f"{tmp_path}/in")
    stream = lambda: corpus.stream_corpus(spark, f"{tmp_path}/in", "parquet", "doc_id long, text string")
    one_file = lambda s: s
    corpus.start_append(one_file(stream()), f"{tmp_path}/copy", f"{tmp_path}/c1").awaitTermination()
    assert sorted(spark.read.parquet(f"{tmp_path}/copy").collect()) == sorted(docs.collect())
    corpus.start_piece_counts(stream(), BYTE_LEVEL, f"{tmp_path}/counts", f"{tmp_path}/c2").awaitTermination()
    got = corpus.streamed_piece_counts(spark, f"{tmp_path}/counts")
    assert sorted(got.collect()) == sorted(piece_counts(docs, BYTE_LEVEL).collect())
    model = train_bpe(documents.limit(20), 150)
    corpus.start_encode(stream(), model, f"{tmp_path}/rows", f"{tmp_path}/c3", 64).awaitTermination()
    want = build_training_rows(docs, model, 64)
    assert sorted(spark.read.parquet(f"{tmp_path}/rows").collect()) == sorted(want.collect())


def test_token_table(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "doc_id long, input_ids array<int>")
    writers.write_tokens(df, f"{tmp_path}/t")
    writers.write_tokens(df.withColumn("doc_id", F.lit(2).cast("long")), f"{tmp_path}/t", "test")
    assert readers_rows(writers.read_tokens(spark, f"{tmp_path}/t")) == [(1, [1, 2])]


def readers_rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("profile,eos,n", [("BYTE_LEVEL", "<|im_end|>", 13), ("DIGITS_ONLY", "<|endoftext|>", 2), ("CHARACTERS", "<|endoftext|>", 2)])
def test_roles_follow_the_profile(spark, documents, tmp_path, profile, eos, n):
    from glyphmill import model as models
    from glyphmill.operators.training import train_char_bpe

    own = getattr(models, profile)
    train = train_char_bpe if profile == "CHARACTERS" else train_bpe
    save_vocab(train(documents.limit(3), None, profile=own, max_merges=2), f"{tmp_path}/m")
    again = load_vocab(spark, f"{tmp_path}/m")
    rows = special_tokens_map(again).collect()
    assert again.profile == own
    assert [r.content for r in rows if r.role == "eos_token"] == [eos]
    assert [r.content for r in rows if r.role == "pad_token"] == ["<|endoftext|>"]
    assert sum(r.role == "additional_special_tokens" for r in rows) == n
    assert pad_id(again) == next(r.token_id for r in rows if r.role == "pad_token")


def test_strict_lines_fail_whatever_is_read(spark, tmp_path):
    put(f"{tmp_path}/x.jsonl", '{"text": "a"}\n{"other": 1}\n')
    for use in (lambda d: d.count(), lambda d: d.select("source_file").collect(), lambda d: d.collect()):
        with pytest.raises(Exception, match="without text"):
            use(readers.read_jsonl(spark, f"{tmp_path}/x.jsonl"))
