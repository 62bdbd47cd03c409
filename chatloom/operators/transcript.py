"""Reading order, transcripts for readers and for extraction, captions and image budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.lines import doc_line, model_line, resolved_title
from ..functions.text import is_ui_noise
from .scan import ROWS_PER_SLICE, carry_scan, number_by_ranges, slice_of


def chrono_order(messages: DataFrame, keys: list[str], seq: str = "seq", width: int = ROWS_PER_SLICE) -> DataFrame:
    """Adds ``at``: the message's time, or the last known time before it. Reading order is
    (``at`` nulls first, ``seq``): a stable sort by time in which undated rows stay with their
    predecessor."""
    return carry_scan(messages, keys, slice_of(seq, width), [F.col(seq)], last={"at": F.col("ts")})


def reading_position(ordered: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """1-based ``pos`` in reading order. Ranges follow the data, so a chat without dates is cut like any other."""
    return number_by_ranges(ordered, keys, [F.col("at").asc_nulls_first(), F.col(seq).asc_nulls_first()], "pos")


def date_separators(messages: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One header row per day, placed before its first dated message.

    In reading order the days of dated messages never go back, so a day changes exactly at the least
    (``ts``, ``seq``) of its messages: an aggregation per day instead of a look-back.
    """
    dated = messages.filter(F.col("ts").isNotNull())
    first = F.min(F.struct("ts", seq))
    return (dated.groupBy(*keys, F.to_date("ts").alias("day")).agg(first.alias("f"))
            .select(*keys, F.col("f.ts").alias("at"), F.col(f"f.{seq}").alias(seq), "day",
                    F.date_format("day", "'■ 'yyyy'年'MM'月'dd'日'").alias("line")))


def transcript_lines(messages: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Lines of the readable transcript in (keys, at, seq, part) order: date headers and messages without
    screen scraps."""
    scrap = ~F.col("kind").isin("voice", "image") & is_ui_noise("text")
    body = (chrono_order(messages, keys, seq).filter(~scrap)
            .select(*keys, "at", seq, F.lit(1).alias("part"), doc_line().alias("line")))
    heads = date_separators(messages, keys, seq).select(*keys, "at", seq, F.lit(0).alias("part"), "line")
    return body.unionByName(heads)


def report_titles(chats: DataFrame, keys: list[str], title: Column, template: Column, chars: int | None = 30) -> DataFrame:
    """Title of each report. Only ``chars`` characters of the joined chat names can show, so one name more is enough per report;
    the rank limit applies before the shuffle. ``chars=None`` joins all names."""
    near = chats.select(*keys, F.col("chat").cast("string").alias("_c")).distinct()
    if chars is not None:
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_c"))).filter(F.col("_r") <= chars + 1)
    names = F.array_join(F.array_sort(F.collect_list("_c")), "、")
    return near.groupBy(*keys).agg(names.alias("_n")).select(*keys, resolved_title(title, F.col("_n"), template, chars).alias("title"))


def image_budget(messages: DataFrame, keys: list[str], n: int = K.EMBEDDED_IMAGES, order: str = "seq") -> DataFrame:
    """The images a transcript embeds: the first ``n`` per chat. The rank limit applies before the
    shuffle, so a chat contributes at most ``n`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(order)
    return (messages.filter(F.col("kind") == "image").withColumn("image_no", F.row_number().over(w))
            .filter(F.col("image_no") <= n))


def apply_captions(messages: DataFrame, captions: DataFrame, n: int = K.CAPTIONED_IMAGES,
                   order: list[str] = ["chat", "seq"]) -> DataFrame:
    """The first ``n`` images overall take their caption as text; images without one keep theirs. An image
    with several captions takes the least of them."""
    one = captions.groupBy("img_path").agg(F.min("caption").alias("caption"))
    first = (messages.filter(F.col("kind") == "image").orderBy(*order).limit(n)
             .select(*order, "img_path").join(one, "img_path").select(*order, "caption"))
    return (messages.join(first, order, "left")
            .withColumn("text", F.coalesce("caption", "text")).drop("caption"))


def merge_chats(messages: DataFrame, by: list[str], chat: str = "chat", seq: str = "seq",
                named: DataFrame | None = None) -> DataFrame:
    """Messages of a report's chats in one stream, with an origin line ahead of each chat when the report
    has more than one. ``named`` (by, chat) has the chats of a report, those without messages too; by
    default they come from the messages. Adds ``part`` (0 origin line, 1 message)."""
    chats = (messages if named is None else named).groupBy(*by, chat).agg(F.count("*").alias("_n"))
    many = chats.groupBy(*by).agg(F.count("*").alias("_c")).filter("_c > 1")
    head = (chats.join(many, by, "left_semi")
            .select(*by, chat, F.lit(0).cast("long").alias(seq), F.lit(0).alias("part"),
                    F.concat(F.lit("===== 聊天来源："), F.col(chat).cast("string"), F.lit(" =====")).alias("line")))
    return messages.withColumn("part", F.lit(1)).unionByName(head, allowMissingColumns=True)


def build_transcript(messages: DataFrame, by: list[str], chat: str = "chat", seq: str = "seq") -> DataFrame:
    """Lines an extraction step reads, in (by, chat, seq) order."""
    body = messages.withColumn("line", model_line()).filter(F.col("line").isNotNull())
    return merge_chats(body.select(*by, chat, seq, "line"), by, chat, seq, messages.select(*by, chat)).select(*by, chat, seq, "part", "line")
