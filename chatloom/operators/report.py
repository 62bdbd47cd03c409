"""From a synthesis reply to the tables of a report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.lines import parse_json_loose
from .mapreduce import timeline
from .scan import number_by_ranges
from .stats import keywords, report_overview, top_speakers, transcript_header


def _text(v: Column) -> Column:
    """A variant as text: strings and numbers as they are, anything else as JSON."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def _list(v: Column, path: str) -> Column:
    """The entries at a path; a single value counts as one entry, nothing as none."""
    one = F.try_variant_get(v, path, "variant")
    return (F.when(one.isNull() | F.is_variant_null(one), F.array().cast("array<variant>"))
            .otherwise(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array(one))))


def report_content(replies: DataFrame, keys: list[str], points: DataFrame | None = None, raw_chars: int | None = None,
                   point_chars: int | None = None) -> DataFrame:
    """What a synthesis reply says: title, summary, ``sections`` (heading, paras), ``conclusions``, ``suggestions``, one row per report.

    ``replies`` has (keys, reply). Replies may stand in a code fence or among prose, entries may be texts instead of objects and
    single values instead of lists. A reply that cannot be read, or has no sections, is kept as well: its text becomes the
    summary if there is no other, and the merged points of the report (``points``: keys, points as JSON) become the only section.
    ``raw_chars`` and ``point_chars`` cut these two; by default they stay whole. A NULL reply counts as an empty one."""
    read = replies.select(*keys, parse_json_loose(F.coalesce("reply", F.lit(""))).alias("j")).select(*keys, "j.value", "j.raw")
    if points is not None:
        read = read.join(points.select(*keys, F.col("points").alias("_points")), keys, "left")
    else:
        read = read.withColumn("_points", F.lit(None).cast("string"))
    cut = lambda c, n: F.substring(c, 1, n) if n else F.col(c)
    part = lambda name: F.coalesce(F.try_variant_get("value", f"$.{name}", "string"), F.lit(""))

    def section(v: Column) -> Column:
        plain = F.try_variant_get(v, "$.heading", "variant").isNull() & F.try_variant_get(v, "$.paras", "variant").isNull()
        paras = F.when(plain, F.array(_text(v))).otherwise(F.transform(_list(v, "$.paras"), _text))
        return F.struct(F.coalesce(F.try_variant_get(v, "$.heading", "string"), F.lit("")).alias("heading"), paras.alias("paras"))

    sections = F.transform(_list(F.col("value"), "$.sections"), section)
    texts = lambda name: F.transform(_list(F.col("value"), f"$.{name}"), _text)
    d = read.select(*keys, "raw", "_points", part("title").alias("title"), part("summary").alias("summary"), sections.alias("sections"),
                    texts("conclusions").alias("conclusions"), texts("suggestions").alias("suggestions"))
    unread = F.col("raw").isNotNull() | (F.size("sections") == 0)
    only = F.struct(F.lit(K.FALLBACK_HEADING).alias("heading"), F.array(F.coalesce(cut("_points", point_chars), F.lit("{}"))).alias("paras"))
    return d.select(*keys, "title", F.when(unread & (F.col("summary") == ""), F.coalesce(cut("raw", raw_chars), F.lit(""))).otherwise(F.col("summary")).alias("summary"),
                    F.when(F.size("sections") == 0, F.array(only)).otherwise(F.col("sections")).alias("sections"), "conclusions", "suggestions")


def section_rows(content: DataFrame, keys: list[str]) -> DataFrame:
    """One row per paragraph: (no, heading, para_no, para). A section without paragraphs keeps its heading."""
    s = content.select(*keys, F.posexplode("sections").alias("no", "s"))
    return s.select(*keys, (F.col("no") + 1).alias("no"), "s.heading", F.posexplode_outer("s.paras").alias("p", "para")).select(
        *keys, "no", "heading", (F.col("p") + 1).alias("para_no"), "para")


def conclusion_rows(content: DataFrame, keys: list[str]) -> DataFrame:
    """Conclusions and then suggestions, each numbered from 1: (part, no, text)."""
    def numbered(c: str) -> Column:
        return F.transform(c, lambda t, i: F.struct(F.lit(c[:-1]).alias("part"), (i + 1).alias("no"), t.alias("text")))

    return content.select(*keys, F.inline(F.concat(numbered("conclusions"), numbered("suggestions"))))


def timeline_points(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Entries (pos, date, desc) of a timeline reply; a reply that cannot be read has none."""
    read = replies.select(*keys, parse_json_loose(F.coalesce("reply", F.lit(""))).alias("j")).filter("j.raw is null")
    each = read.select(*keys, F.posexplode(_list(F.col("j.value"), "$.items")).alias("pos", "v"))
    field = lambda c: F.coalesce(F.try_variant_get("v", f"$.{c}", "string"), F.lit("")).alias(c)
    return each.select(*keys, "pos", field("date"), field("desc"))


def image_rows(captions: DataFrame, keys: list[str], order: str = "image_no") -> DataFrame:
    """Captioned images of a report with their place in it, from 1: ``captions`` has (keys, order, img_path, caption)."""
    numbered = number_by_ranges(captions.select(*keys, order, "img_path", "caption"), keys, [F.col(order), F.col("img_path")], "no")
    return numbered.select(*keys, "no", "img_path", F.concat(F.lit("图 "), F.col("no").cast("string"), F.lit("　"), "caption").alias("caption"))


def report_tables(messages: DataFrame, replies: DataFrame, keys: list[str], points: DataFrame | None = None,
                  timeline_replies: DataFrame | None = None, dated: DataFrame | None = None, captions: DataFrame | None = None,
                  speakers: int = 10, timeline_rows: int = K.TIMELINE_ROWS) -> dict[str, DataFrame]:
    """The seven tables of a report, for ``sources.sinks.write_report_tables``. The timeline comes from ``timeline_replies`` or, without
    a model, from ``dated`` points (keys, date, desc, chunk_no, pos)."""
    content = report_content(replies, keys, points)
    out = {"overview": report_overview(messages, keys), "speakers": top_speakers(messages, speakers, keys), "keywords": keywords(messages, by=keys),
           "sections": section_rows(content, keys), "conclusions": conclusion_rows(content, keys)}
    if timeline_replies is not None:
        out["timeline"] = timeline(timeline_points(timeline_replies, keys), keys, timeline_rows, ["pos"])
    elif dated is not None:
        out["timeline"] = timeline(dated, keys, timeline_rows)
    if captions is not None:
        out["images"] = image_rows(captions, keys)
    return out


def head_lines(messages: DataFrame, as_of: datetime, window: str = "", coverage: DataFrame | None = None, chat: str = "chat") -> DataFrame:
    """The three lines ahead of a transcript, (chat, head_no, line): title, what was exported, note. A stored ``coverage`` (chat,
    coverage) goes before the days of the messages."""
    h = transcript_header(messages, chat)
    if coverage is not None:
        stored = coverage.groupBy(chat).agg(F.max("coverage").alias("_stored"))
        h = h.join(stored, h[chat].eqNullSafe(stored[chat]), "left").drop(stored[chat]).withColumn("span", F.coalesce(F.nullif("_stored", F.lit("")), "span"))
    name = F.coalesce(F.col(chat).cast("string"), F.lit(""))
    facts = F.format_string("导出时间：%s　·　时间窗：%s（实际覆盖 %s）　·　文字 %d 条 / 图片 %d 张 / 语音 %d 条", F.lit(f"{as_of:%Y-%m-%d %H:%M}"),
                            F.lit(window or "全部可见记录"), "span", "n_text", "n_image", "n_voice")
    lines = F.array(F.concat(name, F.lit(" · 聊天记录")), facts, F.lit(K.EXPORT_NOTE))
    return h.select(chat, F.posexplode(lines).alias("head_no", "line"))
