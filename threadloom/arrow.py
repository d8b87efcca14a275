"""Helpers for ``mapInArrow`` functions that stream sorted partitions group by group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, slice) for each run of rows with equal first ``keys`` columns inside a batch.

    A group that spans batches comes in several slices, one after another; the caller joins them.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        change[0] = True
        for c in range(keys):
            col = batch.column(c)
            if n > 1:
                # null and value differ, null and null don't
                a, b = col.slice(0, n - 1), col.slice(1)
                same = pc.equal(a, b)
                both = pc.and_(pc.is_null(a), pc.is_null(b))
                eq = pc.or_(pc.fill_null(same, False), both)
                change[1:] |= ~eq.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(change)
        for s, e in zip(starts, np.append(starts[1:], n)):
            yield tuple(batch.column(c)[int(s)].as_py() for c in range(keys)), batch.slice(int(s), int(e - s))


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Whole groups of a partition sorted by its first ``keys`` columns; only for groups of bounded size."""
    key, parts = None, []
    for k, part in runs(batches, keys):
        if parts and k != key:
            yield key, parts
            parts = []
        key = k
        parts.append(part)
    if parts:
        yield key, parts


def matrix(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    """A binary column of equally long values as a 2-d array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros((0, 0), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    flat = np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return flat.view(dtype).reshape(n, -1)


def binary(rows: np.ndarray) -> pa.Array:
    """The rows of a 2-d array as a binary column."""
    n, width = len(rows), rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
