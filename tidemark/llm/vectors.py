"""What the operators on embeddings share: which vectors take part, whole-number components, exact products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components become floor(SCALE * x).
SCALE = 256.0
#: Whole components lie below this, so that squared distances of 64 of them fit a long.
LARGEST = 1 << 27


def finite(v: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(v: Column) -> Column:
    """floor(256 * x) of each component, as int; components that are too large for exact sums are an error."""

    def one(x: Column) -> Column:
        scaled = F.floor(F.lit(SCALE) * x.cast("double"))
        return F.when((scaled > -LARGEST) & (scaled < LARGEST), scaled.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))

    return F.transform(v, one)


def ints(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of a list column without nulls and with lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def reals(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, each scaled by the power of two that brings its largest component under 1: no cosine changes, and squares stay in range."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    _, power = np.frexp(np.abs(rows).max(axis=1))
    return np.ldexp(rows, -power[:, None])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices: in doubles where all sums are below 2**53."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
