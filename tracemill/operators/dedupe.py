"""Keep the first or the last row of a key, by an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keep(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    g = df.groupBy(*keys).agg(pick(F.struct(*[F.col(c) for c in rest]), by).alias("_row"))
    return g.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the least ``order`` per key, nulls of the order first; null keys are one key. Grouped, so pre-aggregated before the shuffle."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest ``order`` per key; null keys are one key."""
    return _keep(df, keys, order, F.max_by)
