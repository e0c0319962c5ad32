"""Numpy helpers for ragged rows: one flat array of values, with a start and a length for each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that one step of an Arrow operator works on at a time.
STEP_BYTES = 2_000_000


def take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat positions of the given rows, one row after the other."""
    lengths = lengths.astype(np.int64, copy=False)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64, copy=False) - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def slices(batch: pa.RecordBatch, column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``step`` bytes of ``column``, and one row at least."""
    values = batch.column(column)
    if values.null_count == len(values):
        yield from (batch.slice(i, 4096) for i in range(0, len(values), 4096))
        return
    size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group, row = np.cumsum(size) // step, 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(values)]:
        if end > row:
            yield batch.slice(row, end - row)
        row = end
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A column of texts as Python strings; null counts as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()
