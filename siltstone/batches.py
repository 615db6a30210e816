"""Bounded memory in Python workers: small Arrow batches, and freed memory that goes back to the system."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch of texts at most, and bytes that a batch of results is cut at.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold BATCH_ROWS rows at most: a batch of texts lies in memory twice, in the JVM and in Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, a function over a task's batches, giving the memory that it freed back to the system at its end: Python workers outlive their tasks."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole
