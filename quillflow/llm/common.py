"""Helpers shared by the operators: tables, byte views of text columns, ordered numbering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, written

__all__ = ["table", "written", "scratch_dir", "text_bytes", "slices", "partition_number", "part_starts", "without"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of limited bytes: ten thousand long texts at once are too many."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one UTF-8 byte array and the offsets of its rows (nulls are empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = pc.cast(column, pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = offsets[0] if len(offsets) else 0
    return flat[start:offsets[-1] if len(offsets) else 0], offsets - start


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has at most about `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def partition_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def part_starts(counts: DataFrame, part: str, n: str) -> DataFrame:
    """(part, start): what lies before each part. `counts` has one row per task of an earlier job,
    so that the window over all of them is small whatever the size of the data."""
    from pyspark.sql import Window

    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(part).agg(F.sum(n).alias("_n"))
    return totals.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("start"))


def without(rows: DataFrame, *names: str) -> DataFrame:
    """Only the columns named: extra columns of the caller can't clash with the operator's own."""
    return rows.select(*names)
