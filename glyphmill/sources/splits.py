"""Large JSON arrays and CSV files read by byte range.

A scan cuts a file at every ``}`` (JSON) or line end (CSV), each task in its own range of bytes.
Whether a piece starts inside quotes, and how deep in braces, follows from what the ranges before
it add up to: one narrow pass sums up every range, a window over the few ranges of a file gives
where each of them starts.  Pieces of one record are joined inside their range; only a record
that crosses an end of a range moves.  Files are UTF-8.  Compressed files are one range each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

_COMPRESSED = r"\.(gz|bz2|lz4|snappy|zst|deflate)$"
_WHERE = ["_path", "_block"]


def _pieces(spark: SparkSession, paths: str | Sequence[str], end: str) -> DataFrame:
    df = spark.read.option("lineSep", end).text(paths)
    return df.select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_place"),
        F.col("value").alias("_piece"),
    )


def _in_range() -> WindowSpec:
    return Window.partitionBy(*_WHERE).orderBy("_place")


def _count(text: Column, sign: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign)))


def _json_steps(piece: Column) -> tuple[Column, Column, Column]:
    """Quotes of a piece, and its change of depth if it starts outside or inside of quotes.

    No escape reaches over the end of a piece: a backslash before a brace is no JSON.
    """
    plain = F.replace(F.replace(piece, F.lit("\\\\")), F.lit('\\"'))
    quotes, braces = _count(plain, '"'), _count(plain, "{")
    even = quotes % 2 == 0
    # Most pieces are one object, with one brace; only others are searched by a pattern.
    free = _count(F.substring_index(plain, "{", 1), '"') % 2 == 0

    def opened(alone: Column, strings: str) -> Column:
        bare = F.regexp_replace(plain, strings, "")
        return F.when(braces == 0, 0).when(braces == 1, alone.cast("int")).otherwise(_count(bare, "{"))

    outside = opened(free, '"[^"]*("|$)') - even.cast("int")
    inside = opened(~free, '(^|")[^"]*("|$)') - (~even).cast("int")
    return quotes, outside, inside


def _csv_steps(piece: Column) -> tuple[Column, Column, Column]:
    return _count(piece, '"'), F.lit(0), F.lit(0)


def _walked(pieces: DataFrame, steps) -> DataFrame:
    """For either start of a range: is a piece's end inside quotes (``_odd``), and the depth there (``_deep0``, ``_deep1``)."""
    quotes, outside, inside = steps(F.col("_piece"))
    # What ranges are summed up from is taken here, so that their pass shuffles numbers only.
    taken = [(F.octet_length("_piece") + 1).alias("_bytes"), F.col("_piece").rlike(r"^\s*\[").alias("_opens")]
    df = pieces.select("*", quotes.alias("_quotes"), outside.alias("_out"), inside.alias("_in"), *taken)
    so_far = F.sum("_quotes").over(_in_range())
    df = df.select("*", (so_far % 2 == 1).alias("_odd"), ((so_far - F.col("_quotes")) % 2 == 1).alias("_from_odd"))
    deep = [F.sum(F.when(F.col("_from_odd") == F.lit(odd), F.col("_in")).otherwise(F.col("_out"))).over(_in_range()) for odd in (True, False)]
    return df.select("*", deep[0].alias("_deep0"), deep[1].alias("_deep1")).drop("_quotes", "_out", "_in", "_from_odd")


def _range_starts(walked: DataFrame) -> DataFrame:
    """A row per range: how it starts, which crossing record that is, and what the file's end looks like."""
    ranges = walked.groupBy(*_WHERE).agg(
        F.max("_size").alias("_size"),
        F.sum("_bytes").alias("_bytes"),
        F.max_by("_odd", "_place").alias("_flips"),
        F.max_by("_deep0", "_place").alias("_to0"),
        F.max_by("_deep1", "_place").alias("_to1"),
        F.min(F.when(~F.col("_odd"), F.col("_deep0"))).alias("_low0"),
        F.min(F.when(F.col("_odd"), F.col("_deep1"))).alias("_low1"),
        F.min_by("_opens", "_place").alias("_array"),
    )
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_path")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    df = ranges.withColumn("_start_odd", total(F.col("_flips").cast("int")) % 2 == 1)
    df = df.withColumn("_start_deep", total(F.when(F.col("_start_odd"), F.col("_to1")).otherwise(F.col("_to0"))))
    low = F.when(F.col("_start_odd"), F.col("_low1")).otherwise(F.col("_low0")) + F.col("_start_deep")
    # Ranges that end a record; what is left after its last end crosses to the next such range.
    ends = F.coalesce(low <= 0, F.lit(False)).cast("int")
    beyond = F.sum("_bytes").over(whole) - F.col("_size")
    return df.select(
        *_WHERE,
        "_start_odd",
        "_start_deep",
        total(ends).alias("_crossing"),
        (F.max("_block").over(whole) == F.col("_block")).alias("_last_range"),
        # The scan takes a byte order mark of three bytes away.
        (F.col("_path").rlike(_COMPRESSED)).alias("_compressed"),
        beyond.isin(1, -2).alias("_open_end"),
        F.max(F.when(F.col("_block") == 0, F.col("_array"))).over(whole).alias("_array"),
    )


def _records(spark: SparkSession, paths: str | Sequence[str], end: str, steps, check=None) -> DataFrame:
    """(_path, source_file, _first, _record): whole records in any order; ``_first`` marks a file's first one."""
    walked = _walked(_pieces(spark, paths, end), steps)
    starts = _range_starts(walked)
    df = walked.drop("_size", "_bytes", "_opens").join(starts, _WHERE)
    odd = F.col("_odd") != F.col("_start_odd")
    deep = F.when(F.col("_start_odd"), F.col("_deep1")).otherwise(F.col("_deep0")) + F.col("_start_deep")
    df = df.withColumn("_ends", (~odd & (deep <= 0)).cast("int"))
    ended = F.sum("_ends").over(_in_range())
    df = df.withColumns(
        {
            "_nth": ended - F.col("_ends"),
            "_all": F.sum("_ends").over(Window.partitionBy(*_WHERE)),
            "_last": F.col("_last_range") & F.lead("_place").over(_in_range()).isNull(),
        }
    )
    if check is not None:
        df = df.where(check)
    # The first and the last record of a range: the rest of one that began before, and one that may go on after it.
    crosses = (F.col("_nth") == 0) | (F.col("_nth") == F.col("_all"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_place", "_piece"))), lambda p: p["_piece"]), end)
    file = ["_path", "source_file"]
    inside = df.where(~crosses).groupBy(*file, "_block", "_nth").agg(text.alias("_record"))
    number = (F.col("_crossing") + F.when(F.col("_nth") == 0, 0).otherwise(1)).alias("_number")
    over = df.where(crosses).select("*", number).groupBy(*file, "_number").agg(text.alias("_record"))
    over = over.select(*file, (F.col("_number") == 0).alias("_first"), "_record")
    return inside.select(*file, F.lit(False).alias("_first"), "_record").unionByName(over)


def read_json_array(spark: SparkSession, paths: str | Sequence[str], field: str = "completion") -> DataFrame:
    """JSON arrays of objects, one field of each object as ``text``; a file may be of any size.

    Fails on what is no JSON, on elements that are no objects and on arrays that are cut off.
    A file that is one object gives one row.
    """

    def failure(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{what} in "), F.col("_path"))).cast("boolean")

    array = F.coalesce("_array", F.lit(False))
    rest = F.when(array, F.col("_piece").rlike(r"^\s*(\[\s*)?\]\s*$")).otherwise(F.col("_piece").rlike(r"^\s*$"))
    cut = failure("an array that is cut off")
    at_end = (
        F.when(F.col("_compressed"), ~rest)
        .when(F.col("_open_end"), F.when(rest, F.lit(False)).otherwise(cut))
        .otherwise(F.when(array, cut).otherwise(F.lit(True)))
    )
    records = _records(spark, paths, "}", _json_steps, F.when(F.col("_last"), at_end).otherwise(F.lit(True)))
    whole = F.col("_record").rlike(r"^\s*[\[,]?\s*\{")
    records = records.where(F.when(whole, F.lit(True)).otherwise(failure("an element that is no object")))
    body = F.concat(F.substr("_record", F.instr("_record", "{")), F.lit("}"))
    parsed = F.from_json(body, f"`{field}` string", {"mode": "FAILFAST"})
    return records.select(parsed.getField(field).alias("text"), "source_file")


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """CSV files with a header; quoted fields may span lines and hold doubled quotes; a file may be of any size.

    Only quoted fields may hold quotes (others fail).  Without a schema all columns are text, named by the header.
    """
    options = {"header": "true", "multiLine": "true", "escape": '"'}
    options |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if schema is None:
        named = spark.read.options(**options).csv(paths).schema
        schema = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in named.fields)
    records = _records(spark, paths, "\n", _csv_steps)
    line = F.regexp_replace("_record", r"\r\z", "")
    bare = F.regexp_replace(F.replace(line, F.lit('""')), r'(\A|,)"[^"]*+"(?=,|\z)', "")
    stray = F.raise_error(F.concat(F.lit("a quote in an unquoted field, or a field that is not closed, in "), F.col("_path")))
    records = records.select("*", F.when(~bare.contains('"'), line).otherwise(stray.cast("string")).alias("_line"))
    rows = records.where("NOT _first AND _line <> ''")
    parsed = F.from_csv("_line", schema, {k: v for k, v in options.items() if k != "header"}).alias("_row")
    return rows.select(parsed, "source_file").select("_row.*", "source_file")
