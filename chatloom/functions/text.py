"""Column functions on message text and chat names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Name a value once; without it nested conditions repeat the whole expression below them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"(?U)^\s+|\s+$", "")


def characters(c: Column | str) -> Column:
    """The text as an array of code points (``split`` on '' would tear emoji apart)."""
    return F.regexp_extract_all(as_col(c), F.lit("(?s)."), F.lit(0))


def text_fingerprint(c: Column | str, kind: Column | None = None) -> Column:
    """Digest of the text without white space, so that spacing jitter does not matter. Voice marks get
    their own prefix; images bring their own fingerprint (see ``vectors.vector_dhash``)."""
    fp = F.concat(F.lit("t|"), F.md5(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"(?U)\s+", "")))
    if kind is None:
        return fp
    return F.when(kind == "voice", F.concat(F.lit("v|"), fp)).otherwise(fp)


def is_system_notice(c: Column | str) -> Column:
    return F.coalesce(as_col(c).rlike(K.SYSTEM_NOTICE), F.lit(False))


def is_ui_noise(c: Column | str) -> Column:
    """File sizes, clock scraps and up to three Latin letters. Blank text is not noise."""
    t = F.coalesce(as_col(c), F.lit(""))
    return t.rlike(K.SCREEN_SCRAP) & ~F.lower(strip(t)).isin(*K.KEPT_REPLIES)


def is_bad_speaker(c: Column | str) -> Column:
    s = F.coalesce(as_col(c), F.lit(""))
    return is_ui_noise(s) | s.rlike(K.BARE_NUMBER)


def is_meaningful(c: Column | str) -> Column:
    """Worth indexing: two or more characters with a CJK one, or a number or date of six, or an ASCII
    token of four."""
    return F.coalesce(as_col(c).rlike(K.MEANINGFUL), F.lit(False))


def voice_seconds(c: Column | str) -> Column:
    return F.regexp_extract(as_col(c), K.VOICE_MARK, 1).try_cast("int")


def is_voice_mark(c: Column | str) -> Column:
    return F.coalesce(as_col(c).rlike(K.VOICE_MARK), F.lit(False))


def norm_name(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), K.NAME_PUNCTUATION, "")


def folder_name(c: Column | str) -> Column:
    """``safe_name`` with a digest of the whole name: names that look alike once made safe stay apart."""
    return F.concat(safe_name(c), F.lit("-"), F.substring(F.md5(as_col(c)), 1, 12))


def safe_name(c: Column | str, limit: int = 60, default: str = "chat") -> Column:
    """File-system safe form of a chat name."""
    s = F.regexp_replace(as_col(c), r"[^\p{L}\p{N}_-]", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, limit), F.lit("")), F.lit(default))


def strip_fused_suffix(c: Column | str) -> Column:
    """``struct(name, stamp)``: the name without a clock or date the reader glued to it, and that date."""
    def cut(pattern: str):
        def step(v: Column) -> Column:
            tail = F.regexp_extract(v["name"], pattern, 1)
            return let(F.struct(v["name"].alias("name"), v["stamp"].alias("stamp"), tail.alias("tail"), strip(
                F.substring(v["name"], F.lit(1), F.length(v["name"]) - F.length(tail))).alias("rest")), choose)
        return step

    def choose(v: Column) -> Column:
        take = (v["tail"] != "") & (F.length(v["rest"]) >= 2)
        return F.struct(F.when(take, v["rest"]).otherwise(v["name"]).alias("name"),
                        F.when(take, v["tail"]).otherwise(v["stamp"]).alias("stamp"))

    def tidy(v: Column) -> Column:
        return F.struct(strip(F.regexp_replace(v["name"], K.NAME_TAIL, "")).alias("name"), v["stamp"].alias("stamp"))

    whole = F.struct(F.regexp_replace(strip(c), K.FUSED_CLOCK, "").alias("name"), F.lit("").alias("stamp"))
    return let(let(let(whole, cut(K.FUSED_YEAR)), cut(K.FUSED_MONTH_DAY)), tidy)


def character_key(c: Column | str, limit: int | None = None) -> Column:
    """Sorted distinct characters, whole unless a ``limit`` is given: two texts made of the same characters share a key."""
    key = F.array_join(F.array_sort(F.array_distinct(characters(c))), "")
    return F.substring(key, 1, limit) if limit else key


def classify_call_error(c: Column | str) -> Column:
    t = F.coalesce(as_col(c), F.lit(""))
    return F.when(t.contains("429") | t.contains("限流"), "rate_limit").otherwise("other")
