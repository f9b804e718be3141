"""Small helpers between Arrow batches and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per row out of flat values and the number of values of each row."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(values: np.ndarray) -> np.ndarray:
    """uint64 hashes as the BIGINT with the same bits."""
    return np.ascontiguousarray(values).view(np.int64)


def blobs(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a uint8 matrix."""
    n, width = rows.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows))])
