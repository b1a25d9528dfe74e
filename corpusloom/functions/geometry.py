"""Distances between point sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def null_if_nan(x: Column) -> Column:
    """NaN as null, so that min, max and avg leave it out."""
    return F.nullif(x, F.lit(float("nan")))


def rmsd(a: Column, b: Column) -> Column:
    """Root of the mean squared distance of two flat coordinate arrays of one length, points in order."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(squares / (F.size(a) / 3))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def best_superposition(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """RMSD of pairs (n x points x 3) after the best rotation and shift (Kabsch); NaN for non-finite input."""
    ok = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=(1, 2))
    a, b = np.where(ok[:, None, None], a, 0.0), np.where(ok[:, None, None], b, 0.0)
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(np.einsum("npi,npj->nij", a, b))
    s[:, -1] *= np.sign(np.linalg.det(u) * np.linalg.det(vt)) + 0.0
    squares = (a**2).sum(axis=(1, 2)) + (b**2).sum(axis=(1, 2)) - 2 * s.sum(axis=1)
    return np.where(ok, np.sqrt(np.maximum(squares, 0) / a.shape[1]), np.nan)


@F.pandas_udf(DoubleType())
def aligned_rmsd(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """RMSD after superposition, points matched in order; null where lengths differ or a set is null or empty."""
    for a, b in parts:
        sizes = [(len(x), len(y)) if x is not None and y is not None else (0, 1) for x, y in zip(a, b)]
        out = np.full(len(a), np.nan)
        for n in {n for n, m in sizes if n == m and n and n % 3 == 0}:
            at = [k for k, s in enumerate(sizes) if s == (n, n)]
            out[at] = best_superposition(np.stack(a.iloc[at]).reshape(len(at), -1, 3), np.stack(b.iloc[at]).reshape(len(at), -1, 3))
        yield pd.Series(out).where(lambda s: s.notna(), None)
