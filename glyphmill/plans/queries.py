"""One query per operator over the given tables.

Arrays are returned as joined strings, so a comparison sees every element in order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphmill.fixed import CHAR_VOCAB_SIZE, THINK_END
from glyphmill.functions import normalize, pieces
from glyphmill.model import BYTE_LEVEL, BpeModel, added_contents
from glyphmill.operators import batches, chat, codec, counts, epochs, lengths, routing, training, vocabulary
from glyphmill.session import new_path, spread, written
from glyphmill.sources import readers, splits, writers
from glyphmill.streaming import corpus, state

MERGES = 64
OTHER_MERGES = 32
# The training queries themselves learn more than the models that the other queries share.
TRAINED_MERGES = 256
RETRAINED_MERGES = 128
CHAR_MERGES = 128
MAX_LENGTH = 256
ARRAY_BYTES = 8 << 20
SEP = "\x1f"
EXPANSION = ["拉布拉多", "货拉拉", "拉不拉", "拉布拉多"]
ACTIONS = ["<ACTION_1>", "<ACTION_2>", "<think>"]

_models: dict[tuple, BpeModel] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """Columns of ``documents`` over all cores, even where the file has a single split."""
    return spread(documents(spark, sf_dir).select(*columns))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


def _cached(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], BpeModel]) -> BpeModel:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _models:
        _models[key] = build()
    return _models[key]


def corpus_model(spark: SparkSession, sf_dir: str) -> BpeModel:
    return _cached(
        spark, sf_dir, "documents", lambda: training.train_bpe(texts(spark, sf_dir, "text"), None, max_merges=MERGES)
    )


def other_model(spark: SparkSession, sf_dir: str) -> BpeModel:
    """The same profile retrained on the second corpus."""

    def build() -> BpeModel:
        base = corpus_model(spark, sf_dir)
        return training.retrain_like(base, table(spark, sf_dir, "benchmark"), None, max_merges=OTHER_MERGES)

    return _cached(spark, sf_dir, "benchmark", build)


def char_model(spark: SparkSession, sf_dir: str) -> BpeModel:
    return _cached(
        spark, sf_dir, "characters", lambda: training.train_char_bpe(texts(spark, sf_dir, "text"), None, max_merges=CHAR_MERGES)
    )


def joined(ids: str | Column, sep: str = " ") -> Column:
    return F.array_join(F.col(ids) if isinstance(ids, str) else ids, sep)


def six(column: str) -> Column:
    return F.round(F.col(column).cast("double"), 6).alias(column)


# --- sources and sinks -------------------------------------------------------------------


def s1_read_jsonl(spark, sf_dir):
    path = new_path(spark, "jsonl")
    writers.write_jsonl(documents(spark, sf_dir).select("doc_id", "text"), path)
    return readers.read_jsonl(spark, path, "strict", "doc_id long, text string").drop("source_file")


def s2_read_parquet(spark, sf_dir):
    df = readers.read_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id", "text"])
    return df.drop("source_file")


def _line_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("text").agg(F.count("*").alias("n"))


def s3_read_text(spark, sf_dir):
    path = new_path(spark, "lines")
    writers.write_lines(documents(spark, sf_dir), "text", path)
    return _line_counts(readers.read_text(spark, path, strip=True))


def write_arrays(objects: DataFrame, path: str) -> None:
    """The objects ``o`` in JSON arrays of about ``ARRAY_BYTES``, each a file of its own.

    Rows go to an array by their position, so equal rows and rows without an id spread as others do.
    """
    size = objects.agg(F.coalesce(F.sum(F.octet_length(F.to_json("o"))), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, math.ceil(size / ARRAY_BYTES))))
    arrays = objects.select(part.alias("part"), "o").groupBy("part").agg(F.to_json(F.collect_list("o")).alias("value"))
    arrays.write.partitionBy("part").text(path)


def s4_read_json_array(spark, sf_dir):
    path = new_path(spark, "arrays")
    write_arrays(documents(spark, sf_dir).select(F.struct(F.col("text").alias("completion"), "doc_id").alias("o")), path)
    return readers.read_json_array(spark, path, "completion").groupBy("text").agg(F.count("*").alias("n"))


def write_csv(df: DataFrame, path: str) -> None:
    out = df.write.option("header", True).option("escape", '"').option("quoteAll", True)
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def s5_read_csv(spark, sf_dir):
    path = new_path(spark, "csv")
    write_csv(documents(spark, sf_dir).select("doc_id", "lang", "text"), path)
    return readers.read_csv(spark, path, "doc_id long, lang string, text string").drop("source_file")


def s4_read_json_array_ranges(spark, sf_dir):
    path = new_path(spark, "arrays")
    write_arrays(documents(spark, sf_dir).select(F.struct(F.col("text").alias("completion"), "doc_id").alias("o")), path)
    return splits.read_json_array(spark, path, "completion").groupBy("text").agg(F.count("*").alias("n"))


def s5_read_csv_ranges(spark, sf_dir):
    path = new_path(spark, "csv")
    write_csv(documents(spark, sf_dir).select("doc_id", "lang", "text"), path)
    return splits.read_csv(spark, path, "doc_id long, lang string, text string").drop("source_file")


def s6_read_corpus(spark, sf_dir):
    root = new_path(spark, "mixed")
    docs = documents(spark, sf_dir).select("text")
    docs.write.parquet(f"{root}/a")
    writers.write_lines(docs, "text", f"{root}/b")
    items = table(spark, sf_dir, "benchmark").select("text")
    items.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{root}/c")
    said = table(spark, sf_dir, "conversations").select("text")
    said.write.json(f"{root}/d0")
    # JSON lines and JSON arrays differ by their file names, which the writer does not set.
    renamed(spark, f"{root}/d0", f"{root}/d", ".jsonl")
    write_arrays(items.select(F.struct("text").alias("o")), f"{root}/e0")
    renamed(spark, f"{root}/e0", f"{root}/e", ".json")
    found = readers.read_corpus(spark, root, recursive=True)
    return found.groupBy("format", "text").agg(F.count("*").alias("n"))


def renamed(spark: SparkSession, folder: str, target: str, ending: str) -> None:
    """Move the part files of a folder to another one, with another ending."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(target))
    for k, f in enumerate(files.globStatus(path(f"{folder}/{{part-*,*/part-*}}"))):
        files.rename(f.getPath(), path(f"{target}/part-{k:05d}{ending}"))
    files.delete(path(folder), True)


def s7_require_text(spark, sf_dir):
    return readers.require_text(documents(spark, sf_dir)).select("doc_id", F.length("text").cast("long").alias("n_chars"))


def s8_write_jsonl(spark, sf_dir):
    path = new_path(spark, "shards")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = documents(spark, sf_dir).select("doc_id", "source", "text").join(labels, "doc_id", "left")
    writers.write_jsonl(docs.select("doc_id", "quality", "source", "text"), path, shard="source")
    return spark.read.text(path).select("shard", F.col("value").alias("line"))


def s9_write_lines(spark, sf_dir):
    path = new_path(spark, "lines")
    writers.write_lines(table(spark, sf_dir, "conversations"), "text", path)
    return _line_counts(readers.read_text(spark, path))


def s10_tokens(spark, sf_dir):
    path = new_path(spark, "tokens")
    rows = codec.build_training_rows(documents(spark, sf_dir), corpus_model(spark, sf_dir), MAX_LENGTH)
    writers.write_tokens(rows, path)
    return _rows_out(writers.read_tokens(spark, path))


def s11_save_load_vocab(spark, sf_dir):
    path = new_path(spark, "model")
    vocabulary.save_vocab(corpus_model(spark, sf_dir), path)
    return _vocab_out(vocabulary.load_vocab(spark, path).vocab)


def s12_stream_corpus(spark, sf_dir):
    folder, out, mark = (new_path(spark, label) for label in ("lines", "streamed", "progress"))
    writers.write_lines(documents(spark, sf_dir), "text", folder)
    corpus.start_append(corpus.stream_corpus(spark, folder), out, mark).awaitTermination()
    return _line_counts(spark.read.parquet(out))


def folder_bytes(spark: SparkSession, folder: str) -> int:
    listing = spark.read.format("binaryFile").load(folder).select("length")
    return listing.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def s12_stream_corpus_bounded(spark, sf_dir):
    """The folder in about four micro-batches, whatever its size."""
    folder, out, mark = (new_path(spark, label) for label in ("lines", "streamed", "progress"))
    writers.write_lines(texts(spark, sf_dir, "text"), "text", folder)
    stream = corpus.stream_corpus(spark, folder, max_bytes=1 + folder_bytes(spark, folder) // 4)
    corpus.start_append(stream, out, mark).awaitTermination()
    return _line_counts(spark.read.parquet(out))


# --- normalisation -----------------------------------------------------------------------


def n1_normalize_nfc(spark, sf_dir):
    """Composition of decomposed text, so that the form has work to do."""
    decomposed = normalize.normalize_nfd(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", normalize.normalize_nfc(decomposed).alias("text"))


def n2_normalize_nfkc_strip(spark, sf_dir):
    """Over texts given ligatures and separate marks, which the form takes back out."""
    given = F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("."), F.lit(".\u20dd"))
    return documents(spark, sf_dir).select("doc_id", normalize.normalize_nfkc_strip(given).alias("text"))


def n3_normalize_decompose_strip(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", normalize.normalize_decompose_strip(F.col("text")).alias("text"))


# --- pieces ------------------------------------------------------------------------------


def _list_out(df: DataFrame, key: str, items: Column) -> DataFrame:
    rows = df.select(key, items.alias("items"))
    return rows.select(key, F.size("items").cast("long").alias("n"), F.array_join("items", SEP).alias("items"))


def p1_split_pieces(spark, sf_dir):
    return _list_out(texts(spark, sf_dir, "doc_id", "text"), "doc_id", pieces.split_pieces(F.col("text")))


def p2_byte_symbols(spark, sf_dir):
    found = counts.piece_counts(texts(spark, sf_dir, "text"), BYTE_LEVEL)
    return _list_out(found, "piece", pieces.byte_symbols(F.col("piece")))


def p3_split_digits(spark, sf_dir):
    return _list_out(texts(spark, sf_dir, "doc_id", "text"), "doc_id", pieces.split_digits(F.col("text")))


def p4_split_special(spark, sf_dir):
    prompts = chat.render_chat(turns(spark, sf_dir), True)
    return _list_out(prompts, "conv_id", pieces.split_special(F.col("prompt"), BYTE_LEVEL.specials))


def p5_piece_counts(spark, sf_dir):
    return counts.piece_counts(texts(spark, sf_dir, "text"), BYTE_LEVEL)


def p6_char_alphabet(spark, sf_dir):
    return counts.char_alphabet(p5_piece_counts(spark, sf_dir), BYTE_LEVEL).withColumn(
        "position", F.col("position").cast("long")
    )


def p7_streaming_piece_counts(spark, sf_dir):
    folder, out, mark = (new_path(spark, label) for label in ("input", "counts", "progress"))
    texts(spark, sf_dir, "text").write.parquet(folder)
    stream = corpus.stream_corpus(spark, folder, "parquet")
    corpus.start_piece_counts(stream, BYTE_LEVEL, out, mark).awaitTermination()
    return corpus.streamed_piece_counts(spark, out)


def p7_streaming_piece_state(spark, sf_dir):
    """Totals in a state store over about four micro-batches, upserted after each."""
    folder, out, mark = (new_path(spark, label) for label in ("input", "totals", "progress"))
    texts(spark, sf_dir, "text").write.parquet(folder)
    stream = corpus.stream_corpus(spark, folder, "parquet", max_bytes=1 + folder_bytes(spark, folder) // 4)
    state.start_piece_state(stream, BYTE_LEVEL, out, mark).awaitTermination()
    return state.piece_state(spark, out)


# --- training ----------------------------------------------------------------------------


def _coded(spark, sf_dir):
    """Coded words of the corpus and the hex bytes behind each symbol."""
    found = written(p5_piece_counts(spark, sf_dir), "pieces")
    letters = [r.symbol for r in counts.char_alphabet(found, BYTE_LEVEL).orderBy("position").collect()]
    return found, letters, training.coded_words(found, BYTE_LEVEL, letters, range(len(letters)))


def _hex_pair(letters: list[str]) -> tuple[Column, Column]:
    codes = "".join(map(training.code_char, range(len(letters))))
    back = F.translate(F.col("pair"), codes, "".join(letters))
    return pieces.token_hex(F.substring(back, 1, 1)).alias("l"), pieces.token_hex(F.substring(back, 2, 1)).alias("r")


def t1_pair_counts(spark, sf_dir):
    _, letters, words = _coded(spark, sf_dir)
    return counts.pair_counts(words).select(*_hex_pair(letters), "n")


def t2_top_pairs(spark, sf_dir):
    _, letters, words = _coded(spark, sf_dir)
    return counts.top_pairs(counts.pair_counts(words), 200).select(*_hex_pair(letters), "n")


def t3_apply_merges(spark, sf_dir):
    """Every distinct piece after the learned merges, as the hex bytes of its tokens."""
    model = corpus_model(spark, sf_dir)
    found, letters, _ = _coded(spark, sf_dir)
    codes = {t: training.code_char(i) for i, t in enumerate(letters)}
    steps = []
    for r in model.merges.orderBy("rank").collect():
        codes.setdefault(r.merged, training.code_char(len(codes)))
        steps.append((codes[r.left] + codes[r.right], codes[r.merged]))
    symbols = training.coded(pieces.visible_bytes(F.col("piece")), letters, range(len(letters)))
    done = counts.apply_merges(found.select("piece", symbols.alias("syms")), steps)
    hexes = F.split(F.lit(",".join(vocabulary.hex_of_visible(t) for t in codes)), ",")
    first = ord(training.code_char(0))
    tokens = F.transform(F.split("syms", ""), lambda c: F.element_at(hexes, F.ascii(c) - first + 1))
    return done.select("piece", joined(tokens).alias("tokens"))


def t4_train_bpe(spark, sf_dir):
    model = _cached(spark, sf_dir, "longer", lambda: training.train_bpe(texts(spark, sf_dir, "text"), None, max_merges=TRAINED_MERGES))
    return _merges_out(model)


def t5_retrain_like(spark, sf_dir):
    base, items = corpus_model(spark, sf_dir), table(spark, sf_dir, "benchmark")
    model = _cached(spark, sf_dir, "longer-benchmark", lambda: training.retrain_like(base, items, None, max_merges=RETRAINED_MERGES))
    return _merges_out(model)


def _merges_out(model: BpeModel) -> DataFrame:
    sides = [pieces.token_hex(F.col(c)).alias(c[0]) for c in ("left", "right")]
    made = model.vocab.select(F.col("token").alias("merged"), "token_id")
    return model.merges.join(made, "merged").select("rank", *sides, "token_id")


def t6_train_char_bpe(spark, sf_dir):
    return char_model(spark, sf_dir).vocab.select("token_id", "token", "score")


def t4_train_bpe_full(spark, sf_dir):
    """A vocabulary of production size, or until no pair is left."""
    return _merges_out(training.train_bpe(texts(spark, sf_dir, "text"), CHAR_VOCAB_SIZE, exact=False))


def t6_train_char_bpe_full(spark, sf_dir):
    model = training.train_char_bpe(texts(spark, sf_dir, "text"), CHAR_VOCAB_SIZE, exact=False)
    return model.vocab.select("token_id", "token", "score")


def _vocab_out(vocab: DataFrame) -> DataFrame:
    return vocab.select("token_id", "token_hex", "kind")


def t7_vocab_table(spark, sf_dir):
    return _vocab_out(vocabulary.vocab_table(corpus_model(spark, sf_dir)))


# --- vocabulary --------------------------------------------------------------------------


def v1_merge_vocab(spark, sf_dir):
    return _vocab_out(vocabulary.merge_vocab(corpus_model(spark, sf_dir).vocab, other_model(spark, sf_dir).vocab))


def v2_expand_vocab(spark, sf_dir):
    return _vocab_out(vocabulary.expand_vocab(corpus_model(spark, sf_dir).vocab, EXPANSION))


def v3_add_tokens(spark, sf_dir):
    return vocabulary.add_tokens(corpus_model(spark, sf_dir), ACTIONS).added_tokens


def v4_special_tokens_map(spark, sf_dir):
    """The roles and how often each token stands in the rendered conversations."""
    prompts = chat.render_chat(turns(spark, sf_dir), add_generation_prompt=True)
    return vocabulary.special_token_uses(corpus_model(spark, sf_dir), prompts, "prompt")


def v4_vocab_size(spark, sf_dir):
    return vocabulary.vocab_size(vocabulary.add_tokens(corpus_model(spark, sf_dir), ACTIONS))


def v5_compare_vocab(spark, sf_dir):
    rows = codec.compare_vocab(
        corpus_model(spark, sf_dir), other_model(spark, sf_dir), texts(spark, sf_dir, "doc_id", "text")
    )
    names = ["first_ids", "first_tokens", "second_ids", "second_tokens"]
    return rows.select("doc_id", *[joined(n).alias(n) for n in names])


# --- encode and decode -------------------------------------------------------------------


def _encoded(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text", "lang", "source")
    return codec.encode(docs, corpus_model(spark, sf_dir))


def _ids_out(df: DataFrame) -> DataFrame:
    return df.select("doc_id", joined("input_ids").alias("input_ids"))


def _rows_out(df: DataFrame) -> DataFrame:
    names = [c for c in ("input_ids", "attention_mask", "token_type_ids") if c in df.columns]
    return df.select("doc_id", *[joined(c).alias(c) for c in names])


def e1_encode(spark, sf_dir):
    return _ids_out(_encoded(spark, sf_dir))


def e2_tokenize(spark, sf_dir):
    docs = texts(spark, sf_dir, "doc_id", "text")
    rows = codec.tokenize(docs, corpus_model(spark, sf_dir))
    return rows.select("doc_id", joined("tokens").alias("tokens"))


def e3_decode(spark, sf_dir):
    rows = codec.decode(_encoded(spark, sf_dir).drop("text"), corpus_model(spark, sf_dir))
    return rows.select("doc_id", "text")


def e4_truncate(spark, sf_dir):
    rows = _encoded(spark, sf_dir)
    return _ids_out(rows.withColumn("input_ids", codec.truncate(F.col("input_ids"), 64)))


def e5_pad(spark, sf_dir):
    pad_to = 512
    rows = _encoded(spark, sf_dir).withColumn("attention_mask", codec.attention_mask(F.col("input_ids"), pad_to))
    return _rows_out(rows.withColumn("input_ids", codec.pad(F.col("input_ids"), pad_to, 0)))


def _training_rows(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text")
    return codec.build_training_rows(docs, corpus_model(spark, sf_dir), MAX_LENGTH)


def e6_training_rows(spark, sf_dir):
    return _rows_out(_training_rows(spark, sf_dir))


def e7_dropped_symbols(spark, sf_dir):
    return codec.dropped_symbols(texts(spark, sf_dir, "text"), other_model(spark, sf_dir))


def e8_roundtrip_check(spark, sf_dir):
    """With the second corpus's alphabet, so that some texts do lose bytes."""
    docs = texts(spark, sf_dir, "doc_id", "text")
    return codec.roundtrip_check(docs, other_model(spark, sf_dir)).select("doc_id", "same")


def e9_streaming_encode(spark, sf_dir):
    folder, out, mark = (new_path(spark, label) for label in ("input", "rows", "progress"))
    texts(spark, sf_dir, "doc_id", "text").write.parquet(folder)
    stream = corpus.stream_corpus(spark, folder, "parquet", "doc_id long, text string")
    corpus.start_encode(stream, corpus_model(spark, sf_dir), out, mark, MAX_LENGTH).awaitTermination()
    return _rows_out(spark.read.parquet(out))


# --- statistics --------------------------------------------------------------------------


def _lengths(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text", "source")
    return lengths.token_lengths(docs, corpus_model(spark, sf_dir)).drop("text")


def a1_sample_per_file(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return lengths.sample_per_file(docs, 20, 42)


def a2_token_lengths(spark, sf_dir):
    return _lengths(spark, sf_dir).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


def a3_length_stats_per_file(spark, sf_dir):
    stats = lengths.length_stats_per_file(_lengths(spark, sf_dir))
    whole = [F.col(c).cast("long").alias(c) for c in ("count", "min", "max")]
    return stats.select("source", *whole, *[six(c) for c in ("mean", "std", "p50", "p75", "p90", "p95", "p99")])


def a4_length_stats_global(spark, sf_dir):
    stats = lengths.length_stats_global(_lengths(spark, sf_dir))
    whole = [F.col(c).cast("long").alias(c) for c in ("total_samples", "global_max", "recommended_max_length")]
    return stats.select(*whole, six("global_mean"), six("global_95_percentile"))


def a5_recommended_max_length(spark, sf_dir):
    rows = _lengths(spark, sf_dir).groupBy("source")
    return rows.agg(lengths.recommended_max_length().cast("long").alias("recommended_max_length"))


def a6_compression_rate(spark, sf_dir):
    docs = texts(spark, sf_dir, "lang", "text")
    rates = lengths.compression_rate(docs, corpus_model(spark, sf_dir), by="lang")
    ratios = [six(c) for c in ("chars_per_token", "chars_per_row", "tokens_per_row")]
    return rates.select("lang", "n_rows", "n_chars", "n_tokens", *ratios)


def histogram(spark, sf_dir) -> DataFrame:
    """Lengths of all documents per source and language, encoded once for the four queries below."""
    key = (spark.sparkContext.applicationId, sf_dir, "histogram")
    if key not in _histograms:
        docs = texts(spark, sf_dir, "source", "lang", "text")
        _histograms[key] = written(lengths.length_histogram(docs, corpus_model(spark, sf_dir), ["source", "lang"]), "histogram")
    return _histograms[key]


_histograms: dict[tuple, DataFrame] = {}


def a3_length_stats_from_histogram(spark, sf_dir):
    stats = lengths.histogram_stats(histogram(spark, sf_dir))
    return stats.select("source", "count", "min", "max", *[six(c) for c in ("mean", "std", "p50", "p75", "p90", "p95", "p99")])


def a4_length_stats_from_histogram(spark, sf_dir):
    stats = lengths.histogram_stats(histogram(spark, sf_dir), None)
    return stats.select(
        F.col("count").alias("total_samples"),
        F.col("max").alias("global_max"),
        F.col("recommended_max_length").cast("long").alias("recommended_max_length"),
        F.round("mean", 6).alias("global_mean"),
        F.round("p95", 6).alias("global_95_percentile"),
    )


def a5_max_length_from_histogram(spark, sf_dir):
    return lengths.histogram_stats(histogram(spark, sf_dir)).select("source", F.col("recommended_max_length").cast("long").alias("recommended_max_length"))


def a6_compression_from_histogram(spark, sf_dir):
    rates = lengths.histogram_compression(histogram(spark, sf_dir), "lang")
    ratios = [six(c) for c in ("chars_per_token", "chars_per_row", "tokens_per_row")]
    return rates.select("lang", "n_rows", "n_chars", "n_tokens", *ratios)


def a7_skip_bad_files(spark, sf_dir):
    """A broken file among the shards is reported and left out of the totals."""
    root = new_path(spark, "shards")
    texts(spark, sf_dir, "text").write.parquet(root)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/broken.parquet")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(b"not a parquet file"))
    stream.close()
    whole = readers.good_file_totals(spark, root, [F.sum(F.length("text")).alias("n_chars")])
    good = whole.agg(F.lit("read").alias("outcome"), F.sum("n_rows").alias("n"), F.sum("n_chars").alias("n_chars"))
    bad = readers.bad_files(spark, root, whole.select("path")).groupBy(F.concat(F.lit("left out: "), "source_file").alias("outcome"))
    return good.unionByName(bad.agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_chars")))


def a8_corpus_counts(spark, sf_dir):
    return lengths.corpus_counts(documents(spark, sf_dir))


# --- training tables ---------------------------------------------------------------------


def l1_lm_labels(spark, sf_dir):
    rows = _training_rows(spark, sf_dir)
    return rows.select("doc_id", joined(batches.lm_labels(F.col("input_ids"), 0)).alias("labels"))


def l2_position_ids(spark, sf_dir):
    rows = _encoded(spark, sf_dir)
    return rows.select("doc_id", joined(batches.position_ids(F.col("input_ids"))).alias("position_ids"))


def l3_next_token_pairs(spark, sf_dir):
    """Bigram counts of all training rows, from the pairs the operator yields."""
    rows = _training_rows(spark, sf_dir).withColumn("labels", batches.lm_labels(F.col("input_ids"), 0))
    pairs = batches.next_token_pairs(rows)
    total = F.sum(F.col("position").cast("long") * F.col("doc_id"))
    return pairs.groupBy("token_id", "target_id").agg(F.count("*").alias("n"), total.alias("checksum"))


def l4_last_real_token(spark, sf_dir):
    rows = _training_rows(spark, sf_dir)
    last = batches.last_real_token(F.col("input_ids"), 0)
    return rows.select("doc_id", last.cast("long").alias("last_real_token"))


def l5_epoch_batches(spark, sf_dir):
    rows = batches.epoch_batches(documents(spark, sf_dir).select("doc_id"), 42, 1, 4, 3, 2)
    names = ["shuffle_rank", "step", "slot", "worker", "position"]
    return rows.select("doc_id", *[F.col(n).cast("long").alias(n) for n in names])


def l5_epoch_permutation(spark, sf_dir):
    """The same table ordered by a permutation of its row numbers."""
    path = new_path(spark, "numbered")
    rows = epochs.number_rows(documents(spark, sf_dir).select("doc_id"), path)
    return epochs.epoch_order(rows, epochs.n_rows(spark, path), 42, 1, 4, 3, 2).drop("row")


def l6_epoch_summary(spark, sf_dir):
    rows = batches.epoch_summary(table(spark, sf_dir, "documents"), 1, 2, 2, 5)
    return rows.select(*[F.col(c).cast("long").alias(c) for c in rows.columns])


# --- conversations -----------------------------------------------------------------------


def c1_render_chat(spark, sf_dir):
    return chat.render_chat(turns(spark, sf_dir), add_generation_prompt=True, enable_thinking=False)


def c2_render_chat_simple(spark, sf_dir):
    return chat.render_chat_simple(turns(spark, sf_dir), add_generation_prompt=True)


def c3_last_query_turn(spark, sf_dir):
    """With every third user message wrapped as a tool response."""
    wrapped = (F.col("role") == "user") & (F.pmod(F.col("turn") + F.col("conv_id"), F.lit(3)) == 0)
    content = F.concat(F.lit("<tool_response>"), "content", F.lit("</tool_response>"))
    rows = turns(spark, sf_dir)
    return chat.last_query_turn(rows.withColumn("content", F.when(wrapped, content).otherwise(F.col("content"))))


def _thinking(spark, sf_dir) -> DataFrame:
    """The conversation texts with reasoning tags in several arrangements."""
    tagged = F.concat(F.lit("<think>\n"), F.col("content"), F.lit("\n\n</think>\n\n"), F.col("content"))
    twice = F.concat(tagged, tagged)
    unopened = F.concat(F.col("content"), F.lit("</think>"), F.col("content"))
    kind = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(4))
    text = F.when(kind == 0, tagged).when(kind == 1, twice).when(kind == 2, unopened).otherwise(F.col("content"))
    return turns(spark, sf_dir).withColumn("content", text)


def c4_split_reasoning_text(spark, sf_dir):
    parts = chat.split_reasoning_text(F.col("content"))
    return _thinking(spark, sf_dir).select("conv_id", "turn", parts.reasoning.alias("reasoning"), parts.answer.alias("answer"))


def with_tools(df: DataFrame) -> DataFrame:
    """Conversations where assistants call tools and some user turns become tool results."""
    kind = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(5))
    role = F.when((F.col("role") == "user") & kind.isin(0, 1) & (F.col("turn") > 1), "tool").otherwise(F.col("role"))
    one = F.struct(F.lit("search").alias("name"), F.concat(F.lit('{"turn": '), "turn", F.lit("}")).alias("arguments"))
    two = F.struct(F.lit("fetch").alias("name"), F.lit("{}").alias("arguments"))
    calls = F.when(kind == 2, F.array(one, two)).when(kind == 3, F.array(one))
    tools = F.array(F.lit('{"name": "search"}'), F.lit('{"name": "fetch"}'))
    return df.withColumns(
        {
            "role": role,
            "tool_calls": F.when(F.col("role") == "assistant", calls),
            "tools": F.when(F.pmod(F.col("conv_id"), F.lit(2)) == 0, tools),
        }
    )


def c5_tools(spark, sf_dir):
    return chat.render_chat(with_tools(_thinking(spark, sf_dir)))


def c6_encode_chat(spark, sf_dir):
    rows = chat.encode_chat(turns(spark, sf_dir), corpus_model(spark, sf_dir))
    return rows.select("conv_id", joined("input_ids").alias("input_ids"))


def c7_split_reasoning_ids(spark, sf_dir):
    model = corpus_model(spark, sf_dir)
    rows = chat.encode_chat(turns(spark, sf_dir), model, add_generation_prompt=False)
    rows = rows.withColumnRenamed("input_ids", "output_ids")
    end = added_contents(model).index(THINK_END)
    cut = chat.split_reasoning_ids(rows, model, end, F.lit(3))
    ids = [joined(c).alias(c) for c in ("reasoning_ids", "answer_ids")]
    return cut.select("conv_id", *ids, "reasoning", "answer")


# --- expert routing ----------------------------------------------------------------------


def _logits(spark, sf_dir) -> DataFrame:
    values = F.transform("embedding", lambda x: x.cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", values.alias("logits"))


def r1_route_topk(spark, sf_dir):
    rows = routing.route_topk(_logits(spark, sf_dir), 4, renorm=True)
    return rows.select("vec_id", "slot", "expert", six("weight"))


def r2_expert_load(spark, sf_dir):
    return _load_out(routing.expert_load(_logits(spark, sf_dir), 4))


def r2_expert_load_masked(spark, sf_dir):
    return _load_out(routing.expert_load(_logits(spark, sf_dir), 4, mask=F.col("label") % 2 == 0))


def _load_out(df: DataFrame) -> DataFrame:
    return df.select("slot", "expert", six("share"), six("probability"), six("imbalance"))


QUERIES = {name: fn for name, fn in list(globals().items()) if re.match(r"[a-z]\d+_", name)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train a vocabulary, encode the corpus, report characters per token per language."""
    return a6_compression_rate(spark, sf_dir)
