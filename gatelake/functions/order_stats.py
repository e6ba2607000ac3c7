"""Exact order statistics from a histogram.

Values are counted before the shuffle, so a group is as large as its number of
distinct values, and the histogram is cut into value buckets so that no task
scans a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: Mapping[str, Column],
    width: float = 1.0,
) -> DataFrame:
    """One row per ``keys`` with the value at each zero-based position.

    ``positions`` maps an output name to an expression over ``n_values``, the
    number of non-null values of the group.
    """
    keys = list(keys)
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.floor(F.col(value) / F.lit(width)).alias("__b"), F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        hist.groupBy(*keys, "__b")
        .agg(F.sum("__n").alias("__n"))
        .select(
            *keys,
            "__b",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
            F.sum("__n").over(Window.partitionBy(*keys)).alias("n_values"),
        )
    )
    ranked = (
        hist.withColumn("__upto", F.sum("__n").over(inside))
        .join(carry, [*keys, "__b"])
        .withColumn("__upto", F.col("__upto") + F.col("__before"))
        .withColumn("__from", F.col("__upto") - F.col("__n"))
    )
    at = [
        F.max(F.when((F.col("__from") <= pos) & (pos < F.col("__upto")), F.col("__v"))).alias(name)
        for name, pos in positions.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("n_values").alias("n_values"), *at)


def nearest_rank(percent: int) -> Column:
    """Position of the nearest-rank percentile: ``floor(n * percent / 100)``."""
    return F.expr(f"n_values * {int(percent)} div 100")
