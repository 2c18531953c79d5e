"""What the operators share: shared-folder tables, Arrow plumbing, input columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.readers import spread
from millrace.sources.tables import materialize, release, written_bytes

__all__ = ["in_arrow", "materialize", "read", "release", "slices", "small_batches", "small_side", "text_of", "unused", "utf8", "written_bytes"]

#: Bytes of a batch that goes to Python: bounds a worker's memory with long texts.
BATCH_BYTES = 1 << 20
#: Bytes of text that the vectorised kernels take at once.
SLICE_BYTES = 1 << 19
#: Bytes of a written table that may be broadcast; Parquet holds rows in a third to a tenth of their memory.
SMALL_BYTES = 12 << 20


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers give freed memory back when a task ends: they live on, and
    the allocators would keep the peak of every task for them."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
                trim(0)

    return df.mapInArrow(lean, schema)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds a batch to Python by bytes: 10,000 long texts at once may not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each made longer until no column of the table has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str, dealt: bool = True) -> DataFrame:
    """A table; with ``dealt``, one of fewer parts than cores is dealt to all of them."""
    found = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(found) if dealt else found


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all the strings, and n + 1 offsets into them; no copies. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``most`` bytes: (first row, end row, bytes, offsets)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def small_side(df: DataFrame, most: int = 500_000, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """A materialized table, marked for broadcast if it has at most ``most`` rows and
    ``most_bytes`` as written; a larger one is joined by a shuffle."""
    small = written_bytes(df) <= most_bytes and df.count() <= most  # such a count reads footers alone
    return F.broadcast(df) if small else df
