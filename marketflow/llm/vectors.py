"""Blocks of vectors as exact integer matrices, shared by the operators on scaled embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = 2.0**63
EXACT = 2.0**53  # integers up to here are exact doubles


def finite(vector: Column, scale: int) -> Column:
    """Not null, not empty, no null or non-finite component, and every ``scale * component`` fits a long."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LONG / scale / 2))
    return F.coalesce(fits & (F.size(vector) > 0), F.lit(False))


def scaled(column: pa.Array | pa.ChunkedArray, scale: int, width: int | None = None) -> np.ndarray:
    """floor(scale * component) of each vector as doubles, which hold these integers exactly; shorter vectors are padded with zeros."""
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = raw.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = width or int(sizes.max(initial=0))
    whole = np.floor(scale * flat)
    if (sizes == width).all():
        return whole.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


def integers(values: np.ndarray) -> np.ndarray:
    """Integer-valued doubles as Python integers, for products that no machine word holds."""
    return np.array([int(v) for v in values.ravel().tolist()], dtype=object).reshape(values.shape)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` of integer-valued doubles, exactly: doubles, longs or Python integers as the size demands."""
    bound = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, left.shape[1])
    if bound < EXACT:
        return (left @ right.T).astype(np.int64)
    if bound < LONG / 2 and max(np.abs(left).max(initial=0), np.abs(right).max(initial=0)) < LONG / 2:
        return left.astype(np.int64) @ right.astype(np.int64).T
    return integers(left) @ integers(right).T
