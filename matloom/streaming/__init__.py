"""Matrices that grow with a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, row: str, column: str, at: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, row_id, col_id, value: how often rows meet columns in each window of a stream (or table) of events. State is kept per window, and dropped once it is `late`."""
    # A watermark wants a time with a zone: the session's.
    seen = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    return seen.groupBy(F.window(at, every).alias("w"), F.col(row).alias("row_id"), F.col(column).alias("col_id")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.col("w.start").alias("start"), "row_id", "col_id", "value")
