"""Pauses around activity: work stops at the first sign of activity and resumes after silence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timelabel import from_wall_micros, wall_micros
from .scan import slice_of


def activity_pauses(events: DataFrame, keys: list[str], idle: int, ts: str = "ts", span: int = 3600) -> DataFrame:
    """One row per pause: from the first activity while running to the last one plus ``idle`` seconds. A gap
    must exceed ``idle`` to end a pause.

    Events first shrink to partial pauses inside slices of ``span`` seconds; only those, one per slice for
    a busy key, are then put in order per key.
    """
    e = events.filter(F.col(ts).isNotNull()).select(*keys, wall_micros(ts).alias("_t"))
    cut = e.withColumn("_slice", slice_of("_t", span * 1_000_000))

    def split(df: DataFrame, by: list[str], start: str, prev_end) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(start)
        opens = F.coalesce(F.col(start) - prev_end.over(w) > idle * 1_000_000, F.lit(True))
        return (df.withColumn("_open", opens.cast("int"))
                .withColumn("_no", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))))

    part = (split(cut, [*keys, "_slice"], "_t", F.lag("_t")).groupBy(*keys, "_slice", "_no")
            .agg(F.min("_t").alias("_s"), F.max("_t").alias("_e"), F.count("*").alias("_c")).drop("_no"))
    return (split(part, keys, "_s", F.lag("_e")).groupBy(*keys, F.col("_no").alias("pause_no"))
            .agg(from_wall_micros(F.min("_s")).alias("pause_start"),
                 from_wall_micros(F.max("_e") + idle * 1_000_000).alias("resume_at"), F.sum("_c").alias("n_events")))


def pause_counts(pauses: DataFrame, keys: list[str]) -> DataFrame:
    """Pauses and resumes per key. Running starts with a resume, and each pause ends with one."""
    return pauses.groupBy(*keys).agg(F.count("*").alias("n_pauses"), (F.count("*") + 1).alias("n_resumes"))
