"""Row filters. Each takes and returns a DataFrame and leaves the rest of the plan to Catalyst."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import (is_bad_speaker, is_meaningful, is_system_notice, is_ui_noise,
                              is_voice_mark, strip)
from ..functions.timelabel import is_time_label, ntz, parse_window
from .scan import SCREENS_PER_SLICE, with_halo


def texts(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("kind") == "text")


def images(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("kind") == "image")


def voices(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("kind") == "voice")


def filter_time_window(messages: DataFrame, spec: str, as_of: datetime, ts: str = "ts") -> DataFrame:
    """Rows inside the window, both ends included, and rows without a time. The bounds are literals, so
    they reach the scan. A year token selects chats, not rows, and filters nothing here."""
    if len((spec or "").strip()) == 4 and spec.strip().startswith("20") and spec.strip().isdigit():
        return messages
    start, end = parse_window(spec, as_of)
    inside = F.lit(True)
    if start:
        inside = inside & (F.col(ts) >= ntz(start))
    if end:
        inside = inside & (F.col(ts) <= ntz(end))
    return messages.filter(F.col(ts).isNull() | inside) if start or end else messages


def tiered_threshold(blocks: DataFrame, high: float = K.NAME_FLOOR, low: float = K.STAMP_FLOOR) -> DataFrame:
    """One scan, two floors: every row at or above ``low``, flagged where it also reaches ``high``."""
    return (blocks.filter(F.col("score") >= low)
            .withColumn("for_name", F.col("score") >= high)
            .withColumn("for_stamp", F.lit(True)))


def drop_system_noise(messages: DataFrame) -> DataFrame:
    return messages.filter(~is_system_notice("text"))


def drop_ui_noise(messages: DataFrame) -> DataFrame:
    return messages.filter(~is_ui_noise("text"))


def clean_speaker(messages: DataFrame) -> DataFrame:
    """Misread speakers become NULL; ``shown`` is what a reader sees instead."""
    bad = is_bad_speaker("speaker")
    known = F.when(~bad, F.nullif(F.col("speaker"), F.lit("")))
    return (messages.withColumn("shown", F.coalesce(known, F.when(F.col("side") == "right", F.lit("我"))))
            .withColumn("speaker", F.when(~bad, F.col("speaker"))))


def meaningful_lines(lines: DataFrame, keys: list[str], order: str, k: int = 10) -> DataFrame:
    """Per key the first ``k`` different lines worth indexing, in order. Copies collapse in the partial
    aggregation, so a line repeated without end costs one row per task."""
    kept = lines.filter(is_meaningful("text")).select(*keys, strip("text").alias("text"), order)
    first = kept.groupBy(*keys, "text").agg(F.min(order).alias(order))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return first.withColumn("rank", rank).filter(F.col("rank") <= k)


def skip_system_chats(names: DataFrame, skip: tuple[str, ...] = K.SYSTEM_CHATS, name: str = "name") -> DataFrame:
    """Drop exact names on a deny list (a job parameter, hence a literal set)."""
    return names.filter(~F.col(name).isin(*skip)) if skip else names


def layout_denoise(blocks: DataFrame, list_width: int = 0) -> DataFrame:
    """Blocks of a list screen that can be part of an item name or preview."""
    right = int((list_width or 10 ** 6) * K.RIGHT_SHARE)
    t = F.coalesce("text", F.lit(""))
    scrap = t.rlike(K.LAYOUT_SCRAP)
    if list_width:
        scrap = scrap | ((F.col("cx") > right) & t.rlike(r"(?U)^\s*\d+\s*$"))
    return blocks.filter((F.col("cy") >= K.TOP_BAND) & ~scrap)


def route_blocks(blocks: DataFrame) -> DataFrame:
    """``route``: time, voice or text. A time label is never a voice mark, so time is tested first."""
    return blocks.withColumn("route", F.when(is_time_label("text"), "time")
                             .when(is_voice_mark("text"), "voice").otherwise("text"))


def take_until(screens: DataFrame, end: datetime, keys: list[str], screen: str = "screen_idx",
               earliest: str = "earliest") -> DataFrame:
    """Screens up to and including the first whose earliest label lies after ``end``.

    The stop screen of a chat is a minimum, so it aggregates before the shuffle; no ordered window.
    """
    stop = (screens.filter(F.col(earliest) > ntz(end)).groupBy(*keys).agg(F.min(screen).alias("_stop")))
    return (screens.join(stop, keys, "left")
            .filter(F.col("_stop").isNull() | (F.col(screen) <= F.col("_stop"))).drop("_stop"))


def stop_after_idle(screens: DataFrame, keys: list[str], n: int = 20, screen: str = "screen_idx",
                    added: str = "added") -> DataFrame:
    """Screens up to and including the one that completes ``n`` screens in a row adding nothing.
    Screens count up from 0 without holes."""
    cut = with_halo(screens.select(*keys, screen, added), screen, max(SCREENS_PER_SLICE, n), n - 1)
    w = Window.partitionBy(*keys, "_slice").orderBy(screen).rowsBetween(-(n - 1), 0)
    idle = cut.withColumn("_idle", F.count_if(F.col(added) == 0).over(w))
    stop = (idle.filter(~F.col("_ghost") & (F.col("_idle") >= n))
            .groupBy(*keys).agg(F.min(screen).alias("_stop")))
    return (screens.join(stop, keys, "left")
            .filter(F.col("_stop").isNull() | (F.col(screen) <= F.col("_stop"))).drop("_stop"))


