"""Small helpers for functions that map Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def text_slices(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``most`` bytes of column ``text``; a longer text has its own slice."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def returning_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at its end the worker gives back what it no longer uses: workers live on between tasks, and allocators
    would keep a task's peak for as long."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return wrapped


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with ``columns`` after its own; columns of the same name, in any case of letters, are replaced."""
    taken = {n.lower() for n in columns}
    names = [n for n in batch.schema.names if n.lower() not in taken]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns.values()], names=[*names, *columns])


def with_fields(df: DataFrame, columns: dict[str, str]) -> T.StructType:
    """The schema that goes with ``with_columns``."""
    new = T.StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in columns.items()))
    taken = {n.lower() for n in columns}
    return T.StructType([*(f for f in df.schema.fields if f.name.lower() not in taken), *new.fields])
