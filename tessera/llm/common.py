"""Arrow helpers for the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that a task works on at once; one longer text is worked on alone.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with about ``limit`` bytes in ``column`` each."""
    if not batch.num_rows:
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def with_columns(df: DataFrame, text: str, compute: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField], limit: int = SLICE_BYTES, keep_text: bool = False) -> DataFrame:
    """Replace column ``text`` by, or with ``keep_text`` add, the columns that ``compute`` makes from each slice of rows."""
    kept = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + compute(part), names)

    return df.mapInArrow(run, schema)


def raw(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def release() -> None:
    """Give freed memory back to the system, so that a worker does not keep the room of all its blocks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)
