"""Vector columns: which take part, one row per id, dealing to shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors that are not null or empty and whose components are all finite."""
    finite = F.forall(
        F.col(vector),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def one_per_id(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """One row per id, the smallest vector of it; rows without an id are dropped."""
    return (
        rows.where(F.col(key).isNotNull())
        .select(F.col(key), F.col(vector).cast("array<double>").alias(vector))
        .groupBy(key)
        .agg(F.min(vector).alias(vector))
    )


def shard_count(rows: int, shard_rows: int, at_least: int) -> int:
    return max(at_least, -(-rows // shard_rows))


def matrix(column) -> np.ndarray:
    """Rows of a pandas column of equally long arrays."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))
