"""Vectors in Arrow batches and NumPy blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """The vector is there and all of its components are finite numbers."""
    x = F.col(vector)

    def finite(c: Column) -> Column:
        return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))

    return x.isNotNull() & F.forall(x, lambda c: finite(c.cast("double")))


def longest(vectors: DataFrame, vector: str) -> int:
    """Length of the longest usable vector (0 if there is none)."""
    return vectors.filter(usable(vector)).agg(F.max(F.size(vector))).first()[0] or 0


def block(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Lists without nulls as rows of ``size`` doubles; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == size).all():
        return values.reshape(len(column), size)
    out = np.zeros((len(column), size))
    out[np.arange(size)[None, :] < lengths[:, None]] = values
    return out


def rows_as_bytes(rows: np.ndarray) -> list[bytes]:
    rows = np.ascontiguousarray(rows)
    return [r.tobytes() for r in rows]


def from_bytes(column: pa.ChunkedArray | pa.Array, size: int, kind: str) -> np.ndarray:
    """Binary values of equal length as rows of doubles."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(-1, size).astype(np.float64)


def pieces(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
