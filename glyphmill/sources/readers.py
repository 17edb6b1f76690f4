"""Reading corpora. Every reader returns ``text`` first and the file it came from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphmill.fixed import FORMATS

_BAD = "_corrupt_record"


def _with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def strip_ends(col: Column) -> Column:
    """Strip what Python strips; Java's Unicode space class lacks U+001C to U+001F."""
    return F.regexp_replace(col, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def read_jsonl(
    spark: SparkSession, paths: str | Sequence[str], on_bad: str = "strict", schema: str = "text string"
) -> DataFrame:
    """``strict`` fails on bad lines and missing text, ``present`` only on bad lines, ``skip`` on neither."""
    if on_bad not in ("strict", "present", "skip"):
        raise ValueError("on_bad is strict, present or skip")
    return _jsonl(spark.read, paths, on_bad, schema)


def _jsonl(reader, paths: str | Sequence[str], on_bad: str, schema: str) -> DataFrame:
    reader = reader.option("mode", "PERMISSIVE" if on_bad == "skip" else "FAILFAST")
    if on_bad == "skip":
        reader = reader.option("columnNameOfCorruptRecord", _BAD)
        df = _with_file(reader.schema(f"{schema}, {_BAD} string").json(paths))
        return df.where(F.col(_BAD).isNull() & F.col("text").isNotNull()).drop(_BAD)
    df = _with_file(reader.schema(schema).json(paths))
    if on_bad == "present":
        return df.where("text is not null")
    # In a filter, so that no pruning of columns leaves the check out.
    missing = F.raise_error(F.concat(F.lit("a line without text in "), F.col("source_file"))).cast("boolean")
    return df.where(F.when(F.col("text").isNull(), missing).otherwise(F.lit(True)))


def bad_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(line, source_file, text read so far) of lines that do not parse: the report for ``skip``."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD)
    df = _with_file(reader.schema(f"text string, {_BAD} string").json(paths))
    return df.where(F.col(_BAD).isNotNull()).select(F.col(_BAD).alias("line"), "source_file", "text")


def read_parquet(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str] = ("text",)) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*paths)
    require_text(df)
    return _with_file(df).select(*columns, "source_file")


def read_text(spark: SparkSession, paths: str | Sequence[str], strip: bool = False) -> DataFrame:
    """One row per line, empty lines kept."""
    df = _with_file(spark.read.option("lineSep", "\n").text(paths).withColumnRenamed("value", "text"))
    return df.withColumn("text", strip_ends(F.col("text"))) if strip else df


def read_json_array(spark: SparkSession, paths: str | Sequence[str], field: str = "completion") -> DataFrame:
    """Whole-file JSON arrays of objects, one field projected as ``text``."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return _with_file(reader.schema(f"`{field}` string").json(paths)).withColumnRenamed(field, "text")


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """CSV with a header; quoted fields may span lines and hold doubled quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    df = (reader.schema(schema) if schema else reader).csv(paths)
    require_text(df)
    return _with_file(df)


def require_text(df: DataFrame) -> DataFrame:
    """Fail before any job when there is no text column, naming the columns there are."""
    if "text" not in df.columns:
        raise ValueError(f"no 'text' column; the columns are {df.columns}")
    return df


def discover(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """(position, format, path) of supported files, in format order; contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    tests = F.lit(None).cast("string")
    orders = F.lit(None).cast("int")
    for i, (name, extensions) in reversed(list(enumerate(FORMATS.items()))):
        matches = reduce(lambda a, b: a | b, [F.col("path").endswith(e) for e in extensions])
        tests = F.when(matches, name).otherwise(tests)
        orders = F.when(matches, i).otherwise(orders)
    files = listing.select(orders.alias("position"), tests.alias("format"), "path")
    return files.where("format is not null")


def read_corpus(spark: SparkSession, root: str, recursive: bool = False, on_bad: str = "strict") -> DataFrame:
    """All supported files under a folder, each format with its own reader."""
    found = [r["format"] for r in discover(spark, root, recursive).select("format").distinct().collect()]
    if not found:
        known = ", ".join(e for extensions in FORMATS.values() for e in extensions)
        raise FileNotFoundError(f"no corpus files under {root}; supported: {known}")
    parts = []
    for name in (n for n in FORMATS if n in found):
        glob = "*{" + ",".join(FORMATS[name]) + "}"
        reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
        if name == "jsonl":
            df = _jsonl(reader, root, on_bad, "text string")
        elif name == "json":
            df = reader.option("multiLine", True).option("mode", "FAILFAST").schema("text string").json(root)
        elif name == "csv":
            df = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(root)
        elif name == "text":
            df = reader.option("lineSep", "\n").text(root).withColumnRenamed("value", "text")
        else:
            df = reader.parquet(root)
        require_text(df)
        df = df if "source_file" in df.columns else _with_file(df)
        parts.append(df.select("text", "source_file", F.lit(name).alias("format")))
    return reduce(DataFrame.unionByName, parts)


def good_file_totals(spark: SparkSession, root: str, totals: Sequence[Column] = (), schema: str = "text string") -> DataFrame:
    """(path, n_rows, totals) of the parquet files that read to the end, in one scan of their texts.

    The totals are aggregates over a file's rows.  A file may break after its first rows, so its
    totals count only if its texts give as many rows as its footer states.
    """
    reader = spark.read.option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").schema(schema)
    path = F.col("_metadata.file_path").alias("path")
    rows = reader.parquet(root)
    # Without data columns only footers are read.
    stated = rows.select(path).groupBy("path").agg(F.count("*").alias("n_rows"))
    size = F.sum(F.octet_length("text")).alias("_bytes")
    found = rows.select(path, *rows.columns).groupBy("path").agg(F.count("*").alias("n_rows"), size, *totals)
    # The condition on the bytes keeps the text from being pruned away unread.
    return stated.join(found, ["path", "n_rows"]).where("n_rows > 0 AND coalesce(_bytes, 0) >= 0").drop("_bytes")


def bad_files(spark: SparkSession, root: str, good: DataFrame) -> DataFrame:
    """(path, source_file) of the parquet files that are not among ``good``."""
    path = F.col("_metadata.file_path").alias("path")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(root).select(path)
    return listed.join(good, "path", "left_anti").withColumn("source_file", F.element_at(F.split("path", "/"), -1))


def read_good_files(spark: SparkSession, root: str, schema: str = "text string") -> tuple[DataFrame, DataFrame]:
    """Rows of the parquet files that read to the end, and (path, source_file) of the others.

    A file may break after its first rows, so a file counts as good only if reading its text
    gives as many rows as its footer states; a broken one is left out whole.  The rows take a
    second scan; ``good_file_totals`` gives totals in one.
    """
    reader = spark.read.option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").schema(schema)
    path = F.col("_metadata.file_path").alias("path")
    rows = reader.parquet(root)
    good = good_file_totals(spark, root, schema=schema).select("path")
    bad = bad_files(spark, root, good)
    kept = _with_file(rows.withColumn("path", F.col("_metadata.file_path"))).join(good, "path", "left_semi")
    return kept.drop("path"), bad
