"""Vectors as whole numbers, for operators that compare them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are counted in steps of one over this.
SCALE = 256
#: Whole components lie within this; larger ones count as this.
WIDEST = 1 << 62
#: The largest value of a long; what exceeds it is told as this.
LARGEST = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds no null and no non-finite component."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))


def whole(vector: Column) -> Column:
    """floor(SCALE * x) of each component x as a double, within WIDEST."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(WIDEST)), F.least(F.lit(float(WIDEST)), F.lit(float(SCALE)) * x.cast("double")))))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros if a width is given."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if width is None or (lengths == width).all():
        return flat.reshape(len(column), -1)
    out = np.zeros((len(column), width), dtype=flat.dtype)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def magnitude(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices, told within a long."""
    bound = magnitude(a) * magnitude(b) * max(a.shape[1], 1)
    if bound < 1 << 53:  # doubles hold every partial sum as it is
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound <= LARGEST:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.array(np.clip(exact, -LARGEST, LARGEST).tolist(), dtype=np.int64).reshape(exact.shape)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of two matrices row by row, as longs if all fit, else as Python's numbers."""
    if (magnitude(a) + magnitude(b)) ** 2 * max(a.shape[1], 1) <= LARGEST:
        d = a - b
        return np.einsum("ij,ij->i", d, d)
    d = a.astype(object) - b.astype(object)
    return (d * d).sum(axis=1)
