"""Layout of screens: list items, row stamps, nickname lines and image boxes.

A screen holds a few dozen blocks whatever the size of the table, so windows and joins keyed by screen stay
small and spread evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.stamps import is_stamp
from ..functions.text import let, strip, strip_fused_suffix
from ..functions.timelabel import is_time_label
from .filters import layout_denoise


def layout_cluster(blocks: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Number the text ``line`` and list ``item`` of each block on its screen. A gap above 10 starts a line.
    Lines are padded by 10 on both sides and a blank above 12 starts an item, so a gap above 32 does
    both; one ordered pass is enough."""
    w = Window.partitionBy(*keys).orderBy("cy", seq)
    gap = F.col("cy") - F.lag("cy").over(w)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (blocks.withColumn("_gap", gap)
            .withColumn("line", F.count_if(F.col("_gap") > K.LINE_GAP).over(upto))
            .withColumn("item", F.count_if(F.col("_gap") > K.ITEM_GAP + 2 * K.LINE_GAP).over(upto))
            .drop("_gap"))


def item_name(clustered: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Name of each list item: the left-most text of its top line, cleaned; ``fused`` is a date that was
    glued to it. Items without a usable name drop out."""
    top = F.min_by(F.struct("text"), F.struct("line", "cx", "cy", seq))
    items = clustered.groupBy(*keys, "item").agg(top.alias("t"), F.min("cy").alias("row_y"))
    # usable or NULL: one value to test, so that the filter does not repeat the cleaning
    usable = let(strip_fused_suffix("t.text"), lambda c: F.when(
        (F.length(c["name"]) >= 2) & ~c["name"].rlike(K.TIME_OR_BADGE), c))
    clean = items.withColumn("c", usable).filter(F.col("c").isNotNull())
    return clean.select(*keys, "item", "row_y", F.col("c.name").alias("name"), F.col("c.stamp").alias("fused"))


def row_stamp(items: DataFrame, blocks: DataFrame, keys: list[str], list_width: int,
              seq: str = "seq") -> DataFrame:
    """Stamp of each item: the first stamp-like block in the right column of the same row, else the one
    fused to the name. ``blocks`` are the raw blocks: stamps are fainter than names."""
    right = int((list_width or 10 ** 6) * K.RIGHT_SHARE)
    text = strip(F.coalesce("text", F.lit("")))
    marks = (blocks.filter((F.col("cx") > right) & is_stamp(text))
             .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("cy").alias("_y"), F.col(seq).alias("_q"), text.alias("_stamp")))
    # one join, from which items without a mark come back too
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.abs(F.col("_y") - F.col("row_y")) <= K.LINE_GAP]
    near = items.join(marks, on, "left")
    return (near.groupBy(*items.columns).agg(F.min_by("_stamp", "_q").alias("_best"))
            .withColumn("stamp", F.coalesce("_best", "fused")).drop("_best"))


def list_items(blocks: DataFrame, keys: list[str], list_width: int, floor: float = K.NAME_FLOOR,
               stamp_floor: float = K.STAMP_FLOOR, seq: str = "seq") -> DataFrame:
    """Names and stamps of every item on every list screen."""
    names = layout_denoise(blocks.filter(F.col("score") >= floor), list_width)
    items = item_name(layout_cluster(names, keys, seq), keys, seq)
    return row_stamp(items, blocks.filter(F.col("score") >= stamp_floor), keys, list_width, seq)


def stamps_latest(readings: DataFrame, order: list[str], by: list[str] = ["name"]) -> DataFrame:
    """Latest non-empty stamp per name."""
    return (readings.filter(F.col("stamp") != "")
            .groupBy(*by).agg(F.max_by("stamp", F.struct(*order)).alias("stamp")))


def attribute_speaker(blocks: DataFrame, keys: list[str], width: int, seq: str = "seq") -> DataFrame:
    """Nickname above each left-side text: a short block 4 to 44 above it whose left edge is within 90.
    The nearest wins, then the first. ``is_nickname`` marks blocks that served as one.

    Blocks meet by equality on (screen, band of 44), so only neighbours are compared.
    """
    mid = width // 2
    band = 44
    side = F.when(F.col("cx") > mid * 1.02, "right").otherwise("left")
    b = blocks.withColumn("side", side)
    nick = (b.filter((F.length("text") <= 12) & ~is_time_label("text") & (F.col("cx") <= mid))
            .select(*keys, F.floor(F.col("y1") / band).alias("_band"), F.col("y1").alias("_ny1"),
                    F.col("x0").alias("_nx0"), F.col(seq).alias("_nseq"), F.col("text").alias("_nick")))
    reach = F.array_distinct(F.array(F.floor((F.col("y0") - 44) / band), F.floor((F.col("y0") - 4) / band)))
    pairs = (b.filter(F.col("side") == "left").select(*keys, seq, "y0", "x0", F.explode(reach).alias("_band"))
             .join(nick, [*keys, "_band"])
             .filter((F.col(seq) != F.col("_nseq")) & (F.col("y0") - F.col("_ny1")).between(4, 44)
                     & (F.abs(F.col("_nx0") - F.col("x0")) < 90)))
    best = pairs.groupBy(*keys, seq).agg(
        F.min_by(F.struct("_nick", "_nseq"), F.struct(F.col("y0") - F.col("_ny1"), "_nseq")).alias("_n"))
    used = best.select(*keys, F.col("_n._nseq").alias(seq), F.lit(True).alias("is_nickname")).distinct()
    return (b.join(best, [*keys, seq], "left").join(used, [*keys, seq], "left")
            .withColumn("speaker", F.coalesce("_n._nick", F.lit("")))
            .withColumn("is_nickname", F.coalesce("is_nickname", F.lit(False))).drop("_n"))


def box_overlap_anti(boxes: DataFrame, texts: DataFrame, keys: list[str], share: float = 0.4,
                     cell: int = 128) -> DataFrame:
    """Drop boxes (x, y, w, h) that cover more than ``share`` of any text box (x0, y0, x1, y1) on their
    screen. Both sides are laid on a grid; only boxes and texts in a common cell meet."""
    def cells(x0, y0, x1, y1):
        lo = lambda c: F.floor(c / cell)
        return F.explode(F.flatten(F.transform(F.sequence(lo(x0), lo(x1)), lambda i: F.transform(
            F.sequence(lo(y0), lo(y1)), lambda j: F.struct(i.alias("i"), j.alias("j"))))))

    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    b = boxes.withColumn("_cell", cells(x, y, x + w, y + h))
    t = texts.select(*keys, *[F.col(c).alias("_" + c) for c in ("x0", "y0", "x1", "y1")],
                     cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("_cell"))
    ix = F.least(x + w, F.col("_x1")) - F.greatest(x, F.col("_x0"))
    iy = F.least(y + h, F.col("_y1")) - F.greatest(y, F.col("_y0"))
    area = F.greatest(F.lit(1), (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")))
    covering = (b.join(t, [*keys, "_cell"])
                .filter((ix > 0) & (iy > 0) & (ix * iy / area > share)).select(*keys, "x", "y", "w", "h"))
    return boxes.join(covering, [*keys, "x", "y", "w", "h"], "left_anti")


BOX = "struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>"


def merge_boxes(boxes: DataFrame, keys: list[str], iou: float = 0.3) -> DataFrame:
    """Merge the boxes of one screen in (y, x) order: a box joins the first kept box it overlaps by more
    than ``iou``, contains, or lies in. Each merge changes what later boxes meet, so this is an ordered
    fold over the boxes of a screen, with the kept ones as its state."""
    whole = [F.col(c).cast("long").alias(c) for c in ("y", "x", "w", "h")]
    screens = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*whole))).alias("_b"))

    def step(kept: Column, b: Column) -> Column:
        new = F.struct(b["x"].alias("x0"), b["y"].alias("y0"), (b["x"] + b["w"]).alias("x1"), (b["y"] + b["h"]).alias("y1"))

        def meets(k: Column) -> Column:
            wide, high = F.least(k["x1"], new["x1"]) - F.greatest(k["x0"], new["x0"]), F.least(k["y1"], new["y1"]) - F.greatest(k["y0"], new["y0"])
            both = F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0).cast("long"))
            union = F.greatest(F.lit(1).cast("long"), (k["x1"] - k["x0"]) * (k["y1"] - k["y0"]) + b["w"] * b["h"] - both)
            inside = lambda i, o: (o["x0"] <= i["x0"]) & (o["y0"] <= i["y0"]) & (i["x1"] <= o["x1"]) & (i["y1"] <= o["y1"])
            return (both / union > iou) | inside(new, k) | inside(k, new)

        def placed(at: Column) -> Column:
            grown = F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(
                *[F.least(k[c], new[c]).alias(c) for c in ("x0", "y0")], *[F.greatest(k[c], new[c]).alias(c) for c in ("x1", "y1")])).otherwise(k))
            return F.when(at == 0, F.concat(kept, F.array(new))).otherwise(grown)

        return let(F.array_position(F.transform(kept, meets), F.lit(True)), placed)

    kept = F.aggregate("_b", F.array().cast(f"array<{BOX}>"), step)
    each = screens.select(*keys, F.posexplode(kept).alias("box_no", "k"))
    return each.select(*keys, "box_no", *[F.col(f"k.{a}").cast("int").alias(b) for a, b in (("x0", "x"), ("y0", "y"))],
                       *[(F.col(f"k.{a}1") - F.col(f"k.{a}0")).cast("int").alias(b) for a, b in (("x", "w"), ("y", "h"))])
