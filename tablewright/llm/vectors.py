"""Columns of numbers as blocks of packed bytes for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(F.col(vector).cast("array<double>"), bad)


def rows(column: pa.Array) -> list[np.ndarray]:
    """Each vector of an Arrow list column as doubles."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []


def matrix(packed, dtype) -> np.ndarray:
    """Packed vectors as rows; shorter ones are continued with zeros."""
    parts = [np.frombuffer(p, dtype) for p in packed]
    width = max((len(p) for p in parts), default=0)
    if all(len(p) == width for p in parts):
        return np.concatenate(parts).reshape(len(parts), width) if parts else np.zeros((0, width), dtype)
    out = np.zeros((len(parts), width), dtype)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out
