"""Vectors: which take part, and their arithmetic inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def matrix(column) -> np.ndarray:
    """Vectors of one length (an Arrow column of lists) as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in parts]
    return np.concatenate(flat).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same for equal rows wherever they stand."""
    return np.clip((unit(a) * unit(b)).sum(axis=1), -1.0, 1.0)
