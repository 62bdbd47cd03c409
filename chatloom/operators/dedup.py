"""Overlap removal between consecutive screens and screen-level text sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import is_system_notice, text_fingerprint
from .scan import SCREENS_PER_SLICE, number_by_ranges, with_halo


def occurrence_rank(blocks: DataFrame, keys: list[str], screen: str = "screen_idx",
                    order: list[str] | None = None, fp: str = "fp") -> DataFrame:
    """0-based count of the same fingerprint above on the same screen. A group is one text on one screen,
    so it stays small however large the chat is."""
    w = Window.partitionBy(*keys, screen, fp).orderBy(*(order or ["cy"]))
    return blocks.withColumn("rank", F.row_number().over(w) - 1)


def dedup_overlap(ranked: DataFrame, keys: list[str], window: int = K.DEDUP_SCREENS,
                  screen: str = "screen_idx", fp: str = "fp") -> DataFrame:
    """Keep a (fingerprint, rank) that was not seen on the previous ``window - 1`` screens, whether or not
    it was kept there.

    A key occurs at most once per screen, so this is a look-back of ``window - 1`` screens: slices of the
    screen axis, never narrower than that, with a halo bound each group, and one shuffle serves it.
    """
    return _unseen(with_halo(ranked, screen, max(SCREENS_PER_SLICE, window), window - 1), keys, window, screen, fp)


def _unseen(cut: DataFrame, keys: list[str], window: int, screen: str, fp: str) -> DataFrame:
    before = F.lag(screen).over(Window.partitionBy(*keys, fp, "_slice", "rank").orderBy(screen))
    return (cut.withColumn("_before", before)
            .filter(~F.col("_ghost") & (F.col("_before").isNull() | (F.col(screen) - F.col("_before") >= window)))
            .drop("_before", "_slice", "_ghost"))


def compose_messages(blocks: DataFrame, keys: list[str], window: int = K.DEDUP_SCREENS,
                     order: list[str] | None = None, screen: str = "screen_idx") -> DataFrame:
    """Fingerprint, rank, overlap removal and notice removal, in that order: a notice counts for the
    overlap but is no message.

    Rows are placed once by (chat, text, slice of screens). That holds both the rank on a screen and the
    look-back across screens, so the text is shuffled a single time.
    """
    fp = blocks.withColumn("fp", text_fingerprint("text", F.col("kind") if "kind" in blocks.columns else None))
    placed = with_halo(fp, screen, max(SCREENS_PER_SLICE, window), window - 1).repartition(*keys, "fp", "_slice")
    ranked = occurrence_rank(placed, [*keys, "_slice"], screen, order)
    return _unseen(ranked, keys, window, screen, "fp").filter(~is_system_notice("text"))


def frame_text_set(blocks: DataFrame, keys: list[str], screen: str = "screen_idx") -> DataFrame:
    """The set of texts on each screen and a digest of it."""
    texts = F.array_sort(F.collect_set("text"))
    return (blocks.groupBy(*keys, screen).agg(texts.alias("texts"))
            .withColumn("digest", F.md5(F.to_json("texts"))))


def frames_close(a: str, b: str, slack: int = 2):
    """Whether two text sets differ by at most ``slack`` entries of the smaller one."""
    return F.size(F.array_intersect(a, b)) >= F.least(F.size(a), F.size(b)) - slack


def stable_screens(frames: DataFrame, keys: list[str], k: int = 3, screen: str = "screen_idx",
                   digest: str = "digest") -> DataFrame:
    """Screens that close ``k`` repeats in a row of the same text set (``stable``)."""
    cut = with_halo(frames.select(*keys, screen, digest), screen, max(SCREENS_PER_SLICE, k), k)
    w = Window.partitionBy(*keys, "_slice").orderBy(screen)
    same = F.coalesce(F.col(digest) == F.lag(digest).over(w), F.lit(False))
    return (cut.withColumn("same", same)
            .withColumn("stable", F.count_if("same").over(w.rowsBetween(-(k - 1), 0)) >= k)
            .filter(~F.col("_ghost")).drop("_slice", "_ghost"))


def overlap_prev_screen(items: DataFrame, keys: list[str], screen: str = "screen_idx",
                        name: str = "name") -> DataFrame:
    """Items that were not on the previous screen of the same list (exact names)."""
    prev = items.select(*keys, (F.col(screen) + 1).alias(screen), name).distinct()
    return items.join(prev, [*keys, screen, name], "left_anti")


def sort_messages(messages: DataFrame, keys: list[str], screen: str = "screen_idx", y: str = "cy",
                  seq: str = "seq", position: str | None = "pos") -> DataFrame:
    """Natural order: by screen, then top to bottom. ``position`` names a column for the 1-based place in the chat; without it rows
    are only sorted."""
    order = [F.col(c).asc_nulls_first() for c in (screen, y, seq)]
    placed = number_by_ranges(messages, keys, order, position) if position else messages
    return placed.orderBy(*keys, *order)
