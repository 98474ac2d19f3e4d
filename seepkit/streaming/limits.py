"""Running confidence limits over a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepkit.functions.inference import wilson, z_value


def windowed_limits(events: DataFrame, hit: Column, by: str, time: str = "ts", width: str = "1 day", late: str = "1 hour", alpha: float = 0.05) -> DataFrame:
    """Per window and group: k, n and Wilson limits. Works on streams and tables alike; a stream's
    state is one row a group and open window, and events later than ``late`` are left out."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks refuse zoneless times
    if events.isStreaming:
        timed = timed.withWatermark(time, late)
    counts = timed.groupBy(F.window(time, width).alias("w"), by).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("k"), F.count("*").alias("n"))
    limits = wilson(F.col("k"), F.col("n"), z_value(alpha))
    return counts.select(F.col("w.start").alias("start"), by, "k", "n", limits["lo"].alias("lo"), limits["hi"].alias("hi"))
