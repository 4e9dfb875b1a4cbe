"""Arrow batches of vector columns as NumPy matrices, and vector transforms as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(col: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, as float64."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def vectors(m: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    """A matrix as a list column."""
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] if m.ndim > 1 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel(), type=kind))


def dimension(df: DataFrame, vector: str = "vector") -> int:
    """The length that all non-null vectors share; ValueError if they do not."""
    lo, hi = df.select(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).where("hi is not null").collect()[0] if df.where(F.col(vector).isNotNull()).limit(1).count() else (0, 0)
    if lo != hi:
        raise ValueError(f"vectors of {lo} to {hi} components")
    return int(lo)


def l2_normalize(v: Column) -> Column:
    """The vector over its Euclidean norm; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v.cast("array<double>"), lambda x: F.try_divide(x, norm)))


def simplex(v: Column) -> Column:
    """Absolute components over their sum."""
    total = F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.transform(v.cast("array<double>"), lambda x: F.try_divide(F.abs(x), total))
