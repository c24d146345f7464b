"""Helpers for numeric work on Arrow batches of array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Values a kernel sees at once, so that its work space stays a few times 8 MB.
CHUNK_VALUES = 1 << 20


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length as (row numbers, matrix); nulls and empty rows are left out."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    for size in np.unique(sizes[sizes > 0]):
        same = np.flatnonzero(sizes == size)
        for rows in np.array_split(same, -(-len(same) * size // CHUNK_VALUES)):
            yield rows, flat[starts[rows, None] + np.arange(size)]


def to_lists(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """Put matrices back as one list column of ``n`` rows; rows never given are null."""
    sizes = np.zeros(n, dtype=np.int64)
    for rows, matrix in parts:
        sizes[rows] = matrix.shape[1]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.empty(offsets[-1])
    given = np.zeros(n, dtype=bool)
    for rows, matrix in parts:
        flat[offsets[rows, None] + np.arange(matrix.shape[1])] = matrix
        given[rows] = True
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array(~given)
    )


def row_map(kernel: Callable[[np.ndarray], np.ndarray]):
    """An Arrow UDF applying ``kernel`` (matrix in, matrix out) to rows of equal length."""

    @F.arrow_udf("array<double>")
    def apply(column: pa.Array) -> pa.Array:
        return to_lists(len(column), [(rows, kernel(m)) for rows, m in matrices(column)])

    return apply


def row_value(kernel: Callable[[np.ndarray], np.ndarray]):
    """An Arrow UDF reducing every row to one double."""

    @F.arrow_udf("double")
    def apply(column: pa.Array) -> pa.Array:
        values, given = np.zeros(len(column)), np.zeros(len(column), dtype=bool)
        for rows, matrix in matrices(column):
            values[rows], given[rows] = kernel(matrix), True
        return pa.array(values, mask=~given)

    return apply
