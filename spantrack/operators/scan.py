"""Vector helpers for ordered scans over Arrow batches of range-sorted partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(columns: list[pa.Array], last: tuple | None) -> np.ndarray:
    """True where any of the key columns differs from the row before; nulls equal each other.

    ``last`` is the key of the row before the batch, None at the start of the partition.
    """
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    if n == 0:
        return out
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            differ = differ | (
                pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False)
            )
        out[1:] |= differ
    out[0] = last is None or last != key_at(columns, 0)
    return out


def key_at(columns: list[pa.Array], i: int) -> tuple:
    return tuple(c[i].as_py() for c in columns)


def segmented_cummax(segment: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running maximum of int64 ``values`` that restarts with each (non-decreasing) segment number."""
    if not len(values):
        return values
    low, high = int(values.min()), int(values.max())
    span, last = high - low + 1, int(segment[-1]) + 1
    if span * last < 2**62:
        shifted = segment * span + (values - low)
        return np.maximum.accumulate(shifted) - segment * span + low
    distinct, rank = np.unique(values, return_inverse=True)
    shifted = segment * len(distinct) + rank
    return distinct[np.maximum.accumulate(shifted) - segment * len(distinct)]


def single_chunk(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
