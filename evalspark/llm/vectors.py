"""Vector columns for the nearest-neighbour operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def usable(embedding: str) -> Column:
    """True for vectors with finite components only, at least one of them not zero."""
    limit = F.lit(float("inf"))
    return F.coalesce(
        F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
        & F.exists(embedding, lambda x: x != 0), F.lit(False))


def as_doubles(df: DataFrame) -> DataFrame:
    """``(vec_id, vec, dim)`` plus further columns; ``vec`` as array<double>, only usable vectors."""
    rest = [c for c in df.columns if c not in ("vec_id", "embedding")]
    return (df.where(usable("embedding"))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"),
                    F.size("embedding").alias("dim"), *rest))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of one dimension as a float64 matrix."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
