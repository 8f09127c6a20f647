"""The hourly grid as a stream: the same means, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_means(readings: DataFrame, keys: list[str], value: str, late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Mean of each key and hour from a stream with event time ``ts``; readings later than ``late`` are dropped."""
    timed = readings.withColumn(ts, F.col(ts).cast("timestamp"))
    bins = timed.withWatermark(ts, late).groupBy(*keys,
        F.window(ts, "1 hour").alias("_w")).agg(F.avg(value).alias(value))
    return bins.select(*keys, F.col("_w.start").cast("timestamp_ntz").alias("ts"), value)
