"""Helpers for functions that run on Arrow batches in Spark's Python workers.

This module imports nothing of Spark, so that workers stay small.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a function works on at a time.
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where ``column`` (string or binary) passes ``most``
    bytes; a slice holds one row at least. Empty batches are left out."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(column: pa.Array) -> list[str]:
    """Strings of a column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]
