"""Shared pieces of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Space, tab, line feed, vertical tab, form feed, carriage return: what ``bytes.split`` splits at.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator needs, under its own names, so that others cannot clash."""
    return df.select([df[f"`{source}`"].alias(name) for name, source in columns.items()])


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32 of a value's text, modulo ``modulus``; null stays null."""
    return F.pmod(F.crc32(F.encode(col.cast("string"), "UTF-8")), F.lit(modulus))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one hold about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = np.asarray(pc.binary_length(batch.column(at)).fill_null(0), dtype=np.int64)
        if not len(sizes):
            continue
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, for seeds and partitions."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
