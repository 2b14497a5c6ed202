"""The most usual values of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_common(rows: DataFrame, key: str | list[str], value: str, order: str) -> DataFrame:
    """key, value: the most frequent value of each key; of equally frequent ones the one that comes first."""
    key = [key] if isinstance(key, str) else key
    counts = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*key).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value))
