"""Embedding columns as matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(c: Column) -> Column:
    """Not null, no null component, all components finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return c.isNotNull() & F.coalesce(F.forall(F.coalesce(c, F.array().cast("array<double>")).cast("array<double>"), fine), F.lit(False))


def matrix(rows, dtype=np.float64) -> np.ndarray:
    """A row for each vector; shorter ones are filled with zeros."""
    rows = [np.asarray(r, dtype) for r in rows]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), dtype)
    if rows and all(len(r) == width for r in rows):
        return np.stack(rows) if width else out
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))
