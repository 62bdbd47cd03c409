"""Nested chat files: one document per chat (or per part of a large chat) with its messages inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STORED_CHAT
from ..functions.text import as_col
from ..operators.scan import null_safe_join

ROWS_PER_PART = 8192
STAMP = "yyyy-MM-dd HH:mm:ss"


def parse_message_ts(c: Column | str) -> Column:
    """Stored time to timestamp: the first 19 characters; empty or unreadable gives NULL."""
    return F.try_to_timestamp(F.substring(as_col(c), 1, 19), F.lit(STAMP)).cast("timestamp_ntz")


def format_message_ts(c: Column | str) -> Column:
    return F.coalesce(F.date_format(as_col(c), STAMP), F.lit(""))


def read_documents(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Chat documents as stored. ``multi_line`` for one indented document per file, off for JSON lines.
    Keys outside the schema are ignored."""
    return spark.read.schema(STORED_CHAT).option("multiLine", multi_line).json(path)


def register_alias(documents: DataFrame, order: str, alias: str = "alias") -> DataFrame:
    """Give documents another chat name; of several loads of a name the last by ``order`` counts. A load without an order counts
    if no other has one."""
    name = F.coalesce(F.nullif(F.col(alias), F.lit("")), F.coalesce("name", F.lit("")))
    named = documents.withColumn("name", name).drop(alias)
    # the winning load is a maximum per name; documents themselves are not sorted or collected
    last = named.groupBy("name").agg(F.max(order).alias(order))
    return null_safe_join(named, last, ["name", order], "left_semi")


def explode_messages(documents: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """One row per message with its position (``seq`` from 1) and defaults for missing fields."""
    flat = documents.select(F.coalesce("name", F.lit("")).alias("chat"),
                            F.coalesce("part", F.lit(0)).alias("part"), F.posexplode("messages").alias("pos", "m"))
    text = lambda c: F.coalesce(f"m.{c}", F.lit("")).alias(c)
    return flat.select(
        "chat", (F.col("part") * rows_per_part + F.col("pos") + 1).alias("seq"),
        F.coalesce("m.kind", F.lit("text")).alias("kind"), text("text"), text("img_path"),
        F.coalesce("m.box", F.array(*[F.lit(0)] * 4)).alias("box"), text("time_label"),
        parse_message_ts("m.timestamp").alias("ts"), F.coalesce("m.screen_idx", F.lit(0)).alias("screen_idx"),
        text("speaker"), text("side"), text("chat_name"), text("fingerprint"))


def read_chats(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    return explode_messages(read_documents(spark, path, multi_line))


def nest_chats(messages: DataFrame, chats: DataFrame | None = None, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Messages to documents. A chat is cut into parts of ``rows_per_part`` messages, which bounds what any
    one row holds. ``chats`` may bring captured_at, time_window and coverage."""
    have = set(messages.columns)
    field = lambda c, d: (F.coalesce(c, d) if c in have else d).alias(c)
    m = F.struct(
        F.col("seq"), field("kind", F.lit("text")), field("text", F.lit("")), field("img_path", F.lit("")),
        field("box", F.array(*[F.lit(0)] * 4)), field("time_label", F.lit("")),
        (format_message_ts("ts") if "ts" in have else F.lit("")).alias("timestamp"),
        field("screen_idx", F.lit(0)), field("speaker", F.lit("")), field("side", F.lit("")),
        field("chat_name", F.lit("")), field("fingerprint", F.lit("")))
    parts = (messages.withColumn("part", F.floor((F.col("seq") - 1) / rows_per_part))
             .groupBy(F.col("chat").cast("string").alias("name"), "part")
             .agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: x.dropFields("seq")).alias("messages")))
    if chats is not None:
        parts = parts.join(chats, "name", "left")
    blank = [c for c in ("captured_at", "time_window", "coverage") if c not in parts.columns]
    return parts.select("name", *[(F.lit("") if c in blank else F.coalesce(c, F.lit(""))).alias(c)
                                  for c in ("captured_at", "time_window", "coverage")], "part", "messages")


def write_chats(messages: DataFrame, path: str, chats: DataFrame | None = None, mode: str = "errorifexists",
                rows_per_part: int = ROWS_PER_PART) -> None:
    """Store messages as JSON lines, one document per chat part."""
    nest_chats(messages, chats, rows_per_part).write.mode(mode).json(path)
