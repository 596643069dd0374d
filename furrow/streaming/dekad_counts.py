"""Dekad counts of an event stream (an extension). The same plan runs on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import dekad


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need a time stamp with the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """dekad, event_type, n, total. On a stream, state of days past the watermark is let go."""
    e = _timed(events, late) if events.isStreaming else events
    return e.groupBy(dekad.from_date(F.to_date("ts")).alias("dekad"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling days with their dekad, for append mode: a day is final once the watermark has passed it."""
    e = _timed(events, late)
    d = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return d.select(F.col("w.start").alias("day"), dekad.from_date(F.to_date("w.start")).alias("dekad"), "event_type", "n")
