"""Arrow columns of vectors as numpy arrays, and the tests a vector has to pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_searchable(vector: Column, *, zero: bool = False) -> Column:
    """Not NULL, no NULL or non-finite component and, unless ``zero``, some component that is not 0."""
    whole = ~F.exists(vector, lambda x: F.coalesce(F.isnan(x), F.lit(True)) | (F.abs(x) == float("inf")))
    if not zero:
        whole &= F.exists(vector, lambda x: x != 0)
    return F.coalesce(whole, F.lit(False))


def as_matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """One row a vector; vectors shorter than the longest are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    width = int(sizes.max(initial=0))
    if len(values) == width * len(sizes):
        return values.reshape(len(sizes), width)
    full = np.zeros((len(sizes), width), dtype)
    full[np.arange(width) < sizes[:, None]] = values
    return full


def widened(matrix: np.ndarray, width: int) -> np.ndarray:
    missing = width - matrix.shape[1]
    return np.pad(matrix, ((0, 0), (0, missing))) if missing > 0 else matrix


def smallest_of_equal(matrix: np.ndarray, ids: np.ndarray, keep: int, *more: np.ndarray) -> np.ndarray:
    """Positions of the ``keep`` smallest different ids of each distinct row (and value of ``more``)."""
    if not len(ids):
        return np.zeros(0, np.int64)
    rows = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.itemsize * max(1, matrix.shape[1]))))
    _, group = np.unique(rows.ravel(), return_inverse=True) if matrix.shape[1] else (None, np.zeros(len(ids), int))
    keys = [group, *more]
    order = np.lexsort((ids, *keys))
    same = np.ones(len(order) - 1, bool)
    for key in keys:
        same &= key[order[1:]] == key[order[:-1]]
    again = np.concatenate([[False], same & (ids[order[1:]] == ids[order[:-1]])])
    starts = np.concatenate([[True], ~same])
    order, starts = order[~again], starts[~again]
    first = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < keep]


def block_count(rows: int, components: int, block_bytes: int, least: int = 1) -> int:
    """Blocks so that one holds about ``block_bytes`` of vectors, and ``least`` if there are rows enough."""
    return max(1, min(rows, max(least, -(-components * 8 // block_bytes))))


def tiles(df: DataFrame, own: str, other: str, number: int) -> DataFrame:
    """Every row once for each of ``number`` blocks of the other side."""
    return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).withColumn(
        own, F.col(own).cast("int")
    )
