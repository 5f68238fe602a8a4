"""Vectors of whole numbers: quantised in the JVM, exact in tasks whatever their size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = (1 << 63) - 1
# Sums below this are exact in floating point.
EXACT = 1 << 53


def sound(vector: str) -> Column:
    """Neither the vector nor a component is null, and every component is finite."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def whole(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles; a double of 2**52 or more is whole already."""

    def floor(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, floor)


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``row``, a number of their own; store the result, as a second run may number anew."""
    return rows.withColumn("row", F.monotonically_increasing_id())


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of doubles, ended with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy(False)
    flat = lists.flatten().to_numpy(False).astype(float)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def largest(values: np.ndarray) -> float:
    return float(np.abs(values).max(initial=0))


def integers(values: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers, which know no largest one."""
    return np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``, exact, cut to 64 bits."""
    if largest(a) * largest(b) * max(1, a.shape[1]) < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = integers(a) @ integers(b).T
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)
