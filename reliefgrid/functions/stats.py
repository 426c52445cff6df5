"""Weighted statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: str, weight: str) -> Column:
    """Over the rows whose value isn't null."""
    known = F.col(value).isNotNull()
    return F.try_divide(F.sum(F.when(known, F.col(weight) * F.col(value))), F.sum(F.when(known, F.col(weight))))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, out: str) -> DataFrame:
    """Inverse of the weighted distribution, without interpolation: the least value up to which a share q of the weight lies.

    Equal values are brought together first, so that a window sees each value of a group once.
    """
    d = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("w_"))
    up_to = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("c_", F.sum("w_").over(up_to)).withColumn("t_", F.sum("w_").over(Window.partitionBy(*keys)))
    return d.where(F.col("c_") >= F.col("t_") * q).groupBy(*keys).agg(F.min(value).alias(out))


def weighted_coverage(df: DataFrame, keys: list[str], distance: str, weight: str, thresholds: list[float]) -> DataFrame:
    """Share of the weight within each threshold; unreachable rows (null) stay in the denominator. One aggregation."""
    total = F.sum(weight)
    cols = [F.try_divide(F.coalesce(F.sum(F.when(F.col(distance) <= t, F.col(weight))), F.lit(0.0)), total).alias(f"within_{t:g}") for t in thresholds]
    return df.groupBy(*keys).agg(total.alias("total_weight"), *cols)


def coverage_curve(df: DataFrame, distance: str, weight: str, step: float, upto: float) -> DataFrame:
    """(threshold, share) for thresholds 0, step, ... upto: a histogram of `upto / step` bins, then a running sum."""
    n = int(upto // step)
    total = df.agg(F.sum(weight).alias("total"))
    bins = df.where(F.col(distance) <= upto).groupBy(F.ceil(F.greatest(F.col(distance), F.lit(0)) / step).cast("int").alias("k")).agg(F.sum(weight).alias("w"))
    grid = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("k"))
    up_to = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # n + 1 rows
    d = grid.join(bins, "k", "left").withColumn("w", F.sum(F.coalesce("w", F.lit(0.0))).over(up_to))
    return d.join(F.broadcast(total)).select((F.col("k") * step).alias("threshold"), F.try_divide("w", "total").alias("share"))


def distance_band(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bands, the lowest edge included; null and what lies beyond have the last label."""
    out = F.lit(labels[-1])
    for top, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(c <= top, F.lit(label)).otherwise(out)
    return F.when(c.isNull(), F.lit(labels[-1])).otherwise(out)
