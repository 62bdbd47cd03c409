"""Event-time counts and activity sessions. ``ts`` may be a wall-clock type: watermarks need an instant, so
it is read in the session's (UTC) zone and turned back at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(stream: DataFrame, ts: str, late: str) -> DataFrame:
    return stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)


def stream_counts(stream: DataFrame, keys: list[str], every: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Messages per tumbling window. Rows later than the watermark are dropped and show up in the query's
    ``numRowsDroppedByWatermark``."""
    g = _marked(stream, ts, late).groupBy(F.window("_at", every), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


def stream_rate(stream: DataFrame, keys: list[str], length: str = "1 hour", step: str = "15 minutes",
                late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Messages per sliding window."""
    g = _marked(stream, ts, late).groupBy(F.window("_at", length, step), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


def stream_activity_pauses(stream: DataFrame, keys: list[str], idle: str = "30 seconds", late: str = "1 hour",
                           ts: str = "ts") -> DataFrame:
    """A pause opens with activity and closes ``idle`` after the last one; the watermark releases it."""
    g = _marked(stream, ts, late).groupBy(F.session_window("_at", idle), *keys).agg(F.count("*").alias("n_events"))
    return g.select(*keys, F.col("session_window.start").cast("timestamp_ntz").alias("pause_start"),
                    F.col("session_window.end").cast("timestamp_ntz").alias("resume_at"), "n_events")
