"""What the vector operators share: usable vectors, equal vectors as one, rows as matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: Column) -> Column:
    """Neither null, empty nor zero, with finite components only."""
    fine = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(col.isNotNull() & (F.size(col) > 0) & fine & F.exists(col, lambda x: x != 0), F.lit(False))


def plain(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the usable rows; negative zeros become zeros, so equal vectors have equal arrays."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def matrix(column) -> np.ndarray:
    """An Arrow list column without nulls, all lists of one length, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component, which keeps squares within range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows by the plain formula in double precision."""
    a, b = a / np.abs(a).max(axis=-1, keepdims=True), b / np.abs(b).max(axis=-1, keepdims=True)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))
