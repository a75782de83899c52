"""Numpy work on array columns, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a 2-D float64 matrix; every row has the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(column) == 0:
        return flat.reshape(0, width or 0)
    matrix = flat.reshape(len(column), -1)
    if width is not None and matrix.shape[1] != width:
        raise ValueError(f"vectors have {matrix.shape[1]} values, {width} expected")
    return matrix


def to_lists(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int64) * width, type=pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()))


def row_blocks(rows: int, width: int, budget: int = 32 * 1024 * 1024):
    """Slices of a batch whose temporary matrix of ``width`` doubles per row stays within the budget."""
    step = max(1, budget // max(1, 8 * width))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))
