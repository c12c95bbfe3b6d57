"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step works on at once.
CHUNK_BYTES = 4 << 20


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(lengths: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``limit`` bytes; a longer row is a range alone."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def utf8(column: pa.Array) -> list:
    """The texts as bytes (None for null), without decoding."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text_column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes of text, so that little is decoded at once."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(text_column)), 0).to_pylist()
        for i, j in chunks(n, limit):
            yield b.slice(i, j - i)


def release() -> None:
    """Give free memory of this Python worker back: idle workers stay beside later stages, for a minute, with all that they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that none of ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(columns: list[str], *names: str) -> list[str]:
    """The columns but those of the names ``names``, whatever the case: what passes beside a result's own columns."""
    own = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in own]


def with_text(df: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """``df`` and the place of its text as a string: the column itself, or else a cast copy at the end."""
    if dict(df.dtypes)[text_col] == "string":
        return df, df.columns.index(text_col)
    (own,) = fresh(df.columns, "_text")
    return df.withColumn(own, F.col(text_col).cast("string")), len(df.columns)
