"""The newest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .joins import quoted

_RANK = "__rank"


def latest_per_key(df: DataFrame, keys: Sequence[str], order_col: str, tie_breakers: Sequence[str]) -> DataFrame:
    """Keep one row per key: the greatest ``order_col``, then the greatest tie-breakers.

    The tie-breakers must make the order total, so that a task that runs again
    picks the same row. Nulls come last. Spark cuts each map task's rows to one per
    key before the shuffle, so a hot key moves one row per task.
    """
    if not tie_breakers:
        raise ValueError("give tie-breaker columns that make the order total")
    order = [quoted(c).desc_nulls_last() for c in (order_col, *tie_breakers)]
    window = Window.partitionBy(*map(quoted, keys)).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) == 1).drop(_RANK)
