"""Helpers shared by the text operators: column selection, byte batches and runs of bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text is worked on in slices of about so many bytes; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

#: Bytes with A-Z as small letters.
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))

#: The white space between words.
SPACE = " \t\n\x0b\x0c\r"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id (as long) and the text only, under fixed names, so that no other column can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_of_id(name: str = "doc_id") -> Column:
    """CRC-32 of the id as text."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def schema_with(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of `df` and one more column."""
    return StructType([*df.schema.fields, StructField(name, StructType.fromDDL(f"x {kind}")["x"].dataType)])


def sample_rows(rows: DataFrame, most: int) -> DataFrame:
    """All rows if there are at most so many, else about so many, chosen by a hash of the id: between half and twice.

    Where one id, or null, has so many rows that they break these bounds, the hash takes in the text, and the first
    `most` rows by it are chosen. For fitting models only.
    """
    n = rows.select("doc_id").count()
    if n <= most:
        return rows
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    if most // 2 <= drawn.select("doc_id").count() <= 2 * most:
        return drawn
    return rows.orderBy(F.xxhash64("doc_id", "text")).limit(most)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shorten_batches(spark: SparkSession, most: int = 1_000) -> None:
    """From now on jobs of the session hand Python batches of at most so many rows."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= most:
        spark.conf.set(BATCH_ROWS, most)


@contextmanager
def short_batches(spark: SparkSession, most: int = 1_000) -> Iterator[None]:
    """Jobs run in the body hand Python batches of at most so many rows: a batch of texts is held by both sides."""
    before = spark.conf.get(BATCH_ROWS)
    shorten_batches(spark, most)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def slices(
    batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES
) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, UTF-8 texts) of the batch, cut into slices of about `most` bytes."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)) if len(column) else []
    first = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield first, column.slice(first, i - first).to_pylist()
            first, held = i, 0
        held += int(size)
    if first < len(column):
        yield first, column.slice(first).to_pylist()


def joined(texts: list[bytes | None]) -> tuple[bytes, np.ndarray]:
    """All texts with one line feed after each, and where each one starts (one more entry for the end)."""
    whole = b"\n".join([x or b"" for x in texts]) + b"\n"
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x or b"") + 1 for x in texts], out=starts[1:])
    return whole, starts


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true entries; the last entry must be false."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    return edges[::2], edges[1::2]


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct ones of the pieces, in order of appearance, and each piece's number among them.

    Pieces follow one another and none overlap.
    """
    sizes = end - start
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    change = np.zeros(len(data) + 1, np.int8)
    change[start] += 1
    change[end] -= 1
    packed = data[np.cumsum(change[:-1], dtype=np.int8).view(bool)]
    pieces = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    coded = pieces.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
