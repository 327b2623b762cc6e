"""What the operators on embeddings share: which vectors take part, and copies of one vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: str = "v") -> Column:
    """Whether a vector is not null, not empty, all finite and not all zero; never null."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame, vector: str = "v") -> DataFrame:
    """Rows whose vector is usable; as array<double>."""
    return rows.withColumn(vector, F.col(vector).cast("array<double>")).where(is_usable(vector))


def packed(vector: str) -> F.col:
    """An array of doubles as text that is equal only for equal vectors (-0.0 counts as 0.0)."""
    return F.xxhash64(F.transform(vector, lambda x: x + F.lit(0.0)))
