"""Feeding Arrow batches to the per-document helpers in slices of bounded size."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.sources.storage import saved, shared_folder, table  # noqa: F401

#: Bytes of text that a helper sees at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20


def strings(column: pa.Array) -> list[str]:
    """The column's texts; null counts as empty, bytes that are no UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def octets(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema, text_at: int = 1, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with slices of at most `limit` bytes of text. make() runs once a task and
    returns the function for a slice, so that models and caches are built there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = make()
        for batch in batches:
            for part in slices(batch, text_at, limit):
                yield handle(part)

    return df.mapInArrow(run, schema)


def keyed(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns that an operator reads, so that further columns of any name do no harm."""
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col), *more)


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished steps lie on the executors' disks until the driver's garbage collector
    finds that nothing refers to them; this asks for collections, after a step that shuffled much. The first
    finds what Python let go, the second what that held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that hold finite numbers only and width of them, and these as a matrix of doubles."""
    if isinstance(column.type, pa.FixedSizeListType):
        column = column.cast(pa.list_(column.type.value_type))
    lens = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lens == width)
    if not len(rows) or not width:
        return rows[:0], np.zeros((0, width))
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    whole = np.isfinite(values).all(axis=1)
    return rows[whole], values[whole]


def lists(matrix: np.ndarray) -> pa.ListArray:
    """A matrix as a column of lists."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(matrix).ravel()))
