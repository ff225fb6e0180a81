"""Counts and sums per time window of a stream, and rows without repeats, with state bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, ts: str, width: str, late: str, by: list[str], y: str) -> DataFrame:
    """by, start, n, total of each tumbling window; rows later than `late` behind the newest are dropped by a stream.

    A batch gives every window; a stream in append mode gives those that the watermark has closed.
    """
    timed = df.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(*by, F.window("__t", width).alias("w")).agg(F.count("*").alias("n"), F.sum(y).alias("total")).select(*by, F.col("w.start").alias("start"), "n", "total")


def first_of_each(df: DataFrame, ts: str, late: str, key: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
