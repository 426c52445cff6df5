"""Snapshot feeds as streams: an extension, for which the batch operators are the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(stream: DataFrame, key: str, time: str, values: list[str], late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """The last row of each key in each window of event time; state goes once the watermark has passed a window."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key)
    return w.agg(F.max_by(F.struct(time, *values), F.struct(time, *values)).alias("x")).select(F.col("w.start").alias("window_start"), key, "x.*")
