"""Compass traces as a stream: event-time windows with a watermark, the same circular mean as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import fold
from ridgeline.operators.sensors import circular_mean


def windowed_headings(samples: DataFrame, window: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """device, start, headingDeg, spreadDeg, samples of every window; works on streams (append) and on tables.

    samples: device, ts (timestamp), headingDeg. A stream gives a window once the watermark has passed its end.
    """
    rad = F.radians("headingDeg")
    marked = samples.withWatermark("ts", late) if samples.isStreaming else samples
    sums = marked.groupBy("device", F.window("ts", window, slide)).agg(F.sum(F.sin(rad)).alias("sn"), F.sum(F.cos(rad)).alias("cs"), F.count("*").alias("n"))
    mean, spread = circular_mean(F.col("sn"), F.col("cs"), F.col("n").cast("double"))
    return sums.select("device", F.col("window.start").alias("start"), mean.alias("headingDeg"), spread.alias("spreadDeg"), F.col("n").alias("samples"))


def first_seen(samples: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each reading once: later copies of an id within the watermark go."""
    if samples.isStreaming:
        return samples.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return samples.dropDuplicates(["event_id"])


def folded(samples: DataFrame) -> DataFrame:
    return samples.withColumn("headingDeg", fold(F.col("headingDeg")))
