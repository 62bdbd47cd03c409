"""Rendered message lines, report titles and loosely formatted JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import as_col, is_bad_speaker, strip


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def model_line() -> Column:
    """One message as an extraction step reads it; NULL for kinds that are left out."""
    ts = F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.col("time_label"), F.lit(""))
    stamp = F.concat(F.lit("["), ts, F.lit("] "))
    who = F.coalesce(_blank(F.col("speaker")), F.when(F.col("side") == "right", F.lit(K.SELF)))
    text = F.coalesce("text", F.lit(""))
    return (F.when(F.col("kind") == "text",
                   F.concat(stamp, F.coalesce(F.concat(who, F.lit("：")), F.lit("")), text))
            .when(F.col("kind") == "image",
                  F.concat(stamp, F.lit("[图片] "), F.coalesce(_blank(text), F.lit("（图片）"))))
            .when(F.col("kind") == "voice", F.concat(stamp, F.lit("[语音 "), text, F.lit("]"))))


def shown_speaker() -> Column:
    """Speaker prefix of a transcript line; misread speakers are hidden, one's own side shows as self."""
    own = F.when(F.col("side") == "right", F.lit("【我】")).otherwise("")
    known = (_blank(F.col("speaker")).isNotNull()) & ~is_bad_speaker("speaker")
    return F.when(known, F.concat(F.lit("【"), F.col("speaker"), F.lit("】"))).otherwise(own)


def doc_line() -> Column:
    """One message as a reader sees it. Anything but voice and image prints as text."""
    who, text = shown_speaker(), F.coalesce("text", F.lit(""))
    clock = F.coalesce(F.concat(F.lit("　"), F.date_format("ts", "HH:mm")), F.lit(""))
    named = F.when(who != "", F.concat(who, F.lit(" "))).otherwise("")
    return (F.when(F.col("kind") == "voice",
                   F.concat(who, F.lit(" 〔语音 "), text, F.lit("〕"), clock))
            .when(F.col("kind") == "image", F.concat(who, F.lit(" [图片]"), clock))
            .otherwise(F.concat(named, text, clock)))


def resolved_title(title: Column, names: Column, template: Column, chars: int | None = 30) -> Column:
    """Explicit title, or the joined chat names (cut at ``chars``, whole if that is None) with the template's suffix."""
    joined = F.coalesce(_blank(names), F.lit("聊天记录"))
    cut = joined if chars is None else F.when(F.length(joined) > chars, F.concat(F.substring(joined, 1, chars), F.lit("…"))).otherwise(joined)
    suffix = F.lit(K.DEFAULT_TITLE_SUFFIX)
    for name, text in K.TITLE_SUFFIX.items():
        suffix = F.when(template == name, F.lit(text)).otherwise(suffix)
    return F.coalesce(_blank(title), F.concat(cut, suffix))


def parse_json_loose(c: Column | str) -> Column:
    """``struct(value variant, raw string)``: JSON from a reply that may sit in a code fence or between
    other words. ``raw`` keeps the reply where nothing could be read."""
    reply = as_col(c)
    t = strip(F.coalesce(reply, F.lit("")))
    fenced = F.split(F.regexp_replace(t, "^```", ""), "```", 2)[0]
    body = F.when(t.startswith("```"), strip(F.regexp_replace(fenced, "^json", ""))).otherwise(t)
    # (?s): the outermost braces, across lines
    inner = F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))
    value = F.coalesce(F.try_parse_json(_blank(body)), F.try_parse_json(inner))
    return F.struct(value.alias("value"), F.when(value.isNull(), reply).alias("raw"))
