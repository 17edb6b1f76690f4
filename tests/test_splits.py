"""JSON arrays and CSV files read by byte range, against the readers that take a file a task."""

import json
import os
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from glyphmill.sources import readers, splits

WORDS = ["plain", 'quo"te', "br{ace", "}{", "[x]", "two\nlines", "\\", 'end\\"', "ünï 全角", "", "}", '"', ",", "a, b", "  "]


@contextmanager
def ranges(spark, size):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}
    for name, value in zip(names, (size, 1, 1)):
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return str(path)


def rows(df):
    return sorted(map(str, df.collect()))


def objects(rng, n):
    def text():
        return "".join(rng.choice(WORDS) for _ in range(rng.randrange(6)))

    out = []
    for _ in range(n):
        o = {"x": rng.choice([1, None, {"completion": text(), "y": [{"z": text()}]}]), "completion": rng.choice([text(), text() * 20, None])}
        out.append(o if rng.random() < 0.9 else {"x": text()})
    return out


@pytest.mark.parametrize("size", [17, 64, 1000, 1 << 20])
def test_array_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    texts = [
        json.dumps(objects(rng, 60), ensure_ascii=False),
        "﻿ \n" + json.dumps(objects(rng, 25), indent=2) + "\n\n",
        json.dumps(objects(rng, 1)[0]),
        json.dumps(objects(rng, 1)[0]) + "\n",
        "[]",
        " [ \n ] ",
        "",
    ]
    for k, text in enumerate(texts):
        put(f"{tmp_path}/in/a{k}.json", text)
    want = [
        (o.get("completion"), f"a{k}.json")
        for k, text in enumerate(texts)
        if text
        for found in [json.loads(text.lstrip("﻿"))]
        for o in (found if isinstance(found, list) else [found])
    ]
    with ranges(spark, size):
        got = splits.read_json_array(spark, f"{tmp_path}/in")
        assert sorted(map(repr, ((r.text, r.source_file) for r in got.collect()))) == sorted(map(repr, want))


def test_array_faults(spark, tmp_path):
    whole = json.dumps([{"completion": "one"}, {"completion": "two"}])
    cut = [whole[:-1], whole[:-3], whole[:-8], "[", whole[1:], whole + "]"]
    wrong = ["[1, " + whole[1:], whole[:-1] + ", 1]", whole.replace(":", ";", 1), whole[:-1] + "}]"]
    for k, text in enumerate(cut + wrong):
        path = put(f"{tmp_path}/{k}/a.json", text)
        for size in (16, 1 << 20):
            with ranges(spark, size), pytest.raises(Exception):
                splits.read_json_array(spark, path).collect()


def test_array_compressed(spark, tmp_path):
    spark.createDataFrame([(json.dumps([{"completion": w} for w in WORDS]),)], "value string").coalesce(1).write.option(
        "compression", "gzip").text(f"{tmp_path}/gz")
    with ranges(spark, 32):
        assert sorted(r.text for r in splits.read_json_array(spark, f"{tmp_path}/gz").collect()) == sorted(WORDS)


def test_one_large_file_is_many_tasks(spark, tmp_path):
    put(f"{tmp_path}/a.json", json.dumps([{"completion": f"{i} }}" * 50} for i in range(2000)]))
    with ranges(spark, 16384):
        df = splits.read_json_array(spark, f"{tmp_path}/a.json")
        parts = spark.read.option("lineSep", "}").text(f"{tmp_path}/a.json").rdd.getNumPartitions()
        assert parts > 10 and readers.read_json_array(spark, f"{tmp_path}/a.json").rdd.getNumPartitions() == 1
        assert sorted(r.text for r in df.collect()) == sorted(f"{i} }}" * 50 for i in range(2000))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("size", [13, 50, 700, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_ranges(spark, tmp_path, size, end):
    rng = random.Random(size)

    def line(i):
        text = "".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12)))
        return f'{i},"' + text.replace('"', '""') + '",' + rng.choice(["", "bare", " b ", '"q, r"', '""""'])

    for k in range(2):
        body = end.join(["id,text,z"] + [line(i) for i in range(40)]) + (end * 2 if k else "")
        put(f"{tmp_path}/in/{k}.csv", body)
    put(f"{tmp_path}/in/2.csv", "id,text,z" + end)
    schema = "id long, text string, z string"
    want = rows(readers.read_csv(spark, f"{tmp_path}/in", schema))
    with ranges(spark, size):
        assert rows(splits.read_csv(spark, f"{tmp_path}/in", schema)) == want
        unnamed = splits.read_csv(spark, f"{tmp_path}/in")
    assert unnamed.columns == ["id", "text", "z", "source_file"] and len(want) == 80


def test_csv_faults(spark, tmp_path):
    for k, text in enumerate(['id,text\n1,5" disk\n2,x\n', 'id,text\n1,"open\n2,x\n', 'id,text\n1,"a"b\n2,x\n']):
        path = put(f"{tmp_path}/{k}/a.csv", text)
        with pytest.raises(Exception, match="quote"):
            splits.read_csv(spark, path, "id long, text string").collect()


def test_same_rows_as_whole_files(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    one = docs.agg(F.to_json(F.collect_list(F.struct(F.col("text").alias("completion")))).alias("value"))
    one.write.text(f"{tmp_path}/json")
    with ranges(spark, 1 << 15):
        got = splits.read_json_array(spark, f"{tmp_path}/json").select("text")
        assert got.exceptAll(docs.select("text")).isEmpty() and got.count() == docs.count()
