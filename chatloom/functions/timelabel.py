"""Time labels: the relative dates a chat window shows between messages.

Parsing is split in two. ``label_parts`` reads everything the text alone says (JVM expressions). What
depends on the label before it (the year of a month-day label, the date of a bare clock) is settled by
``parse_time_label`` for one given predecessor, or by ``operators.labels.resolve_labels`` along a chat.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import as_col, let, strip


def ntz(t: datetime) -> Column:
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def wall_seconds(c: Column | str) -> Column:
    """Whole seconds since 1970 on the wall clock, whatever the session's time zone."""
    c = as_col(c)
    return F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def wall_micros(c: Column | str) -> Column:
    c = as_col(c)
    part = (F.date_part(F.lit("SECOND"), c) * 1000000).cast("long")
    return (wall_seconds(c) - F.second(c)) * 1000000 + part


def from_wall_micros(c: Column | str) -> Column:
    zero, secs = F.lit(0), as_col(c).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")
    return ntz(datetime(1970, 1, 1)) + F.make_dt_interval(zero, zero, zero, secs.cast("decimal(18,6)"))


def is_time_label(c: Column | str) -> Column:
    return F.coalesce(as_col(c).rlike(K.TIME_LABEL), F.lit(False))


def _moment(day: Column, clock: Column) -> Column:
    zero = F.lit(0)
    return day.cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, clock.cast("decimal(18,6)"))


def _day(y: Column, mo: Column, d: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(y, mo, d, zero, zero, zero.cast("decimal(8,6)")).cast("date")


def label_parts(c: Column | str, as_of: datetime) -> Column:
    """``struct(shape, day, mo, d, clock)``. Shape is ``abs`` (``day`` is final), ``md`` (month and day
    without a year) or ``clock``; NULL if the text is no label or can never be a date. ``clock`` is the
    second of the day."""
    t = strip(F.translate(F.coalesce(as_col(c), F.lit("")), "０１２３４５６７８９", "0123456789"))
    today = F.lit(as_of.date())

    def read(g: Column) -> Column:
        num = lambda i: g[i].try_cast("int")
        return F.struct(num(1).alias("y"), num(2).alias("mo"), num(3).alias("d"), g[4].alias("recent"),
                        (F.instr(F.lit("一二三四五六日"), F.translate(g[5], "天", "日")) - 1).alias("wd"),
                        (g[5] != "").alias("week"),
                        (g[6] != "").alias("timed"), F.coalesce(num(6), F.lit(0)).alias("h"),
                        F.coalesce(num(7), F.lit(0)).alias("mi"), F.coalesce(num(8), F.lit(0)).alias("s"))

    def settle(p: Column) -> Column:
        secs = F.when((p["h"] < 24) & (p["mi"] < 60) & (p["s"] < 60), p["h"] * 3600 + p["mi"] * 60 + p["s"])
        back = F.pmod(F.lit(as_of.weekday()) - p["wd"], F.lit(7))
        day = (F.when(p["y"].isNotNull(), F.when(p["y"].between(K.FIRST_YEAR, as_of.year),
                                                 _day(p["y"], p["mo"], p["d"])))
               # the weekday of today means the one a week ago
               .when(p["week"], F.date_sub(today, F.when(back == 0, 7).otherwise(back).cast("int")))
               .when(p["recent"] != "", F.date_sub(today, F.when(p["recent"] == "昨天", 1).otherwise(2))))
        dated = p["mo"].isNotNull()
        # against a leap year: a month-day pair that no year holds is no label
        shape = (F.when(secs.isNull() | ~(dated | p["timed"]), None).when(day.isNotNull(), "abs")
                 .when(dated & p["y"].isNull() & _day(F.lit(2000), p["mo"], p["d"]).isNotNull(), "md")
                 .when(~dated & ~p["week"] & (p["recent"] == ""), "clock"))
        return F.struct(shape.alias("shape"), day.alias("day"), p["mo"].alias("mo"), p["d"].alias("d"),
                        secs.alias("clock"))

    groups = F.split(F.regexp_replace(t, K.LABEL_SHAPES, "#" + "".join(f"${i}#" for i in range(1, 9))), "#")
    return F.when((t != "") & t.rlike(K.LABEL_SHAPES), let(groups, lambda g: let(read(g), settle)))


def parse_time_label(c: Column | str, as_of: datetime, last_seen: Column | None = None) -> Column:
    """Absolute time of one label; NULL if it is none. ``last_seen`` is the time before it, if known."""
    now = ntz(as_of)
    seen = F.lit(None).cast("timestamp_ntz") if last_seen is None else last_seen
    one, half = F.expr("interval 1 day"), F.expr("interval 12 hours")

    def settle(p: Column) -> Column:
        year = F.coalesce(F.year(seen), F.lit(as_of.year))
        this = _moment(_day(year, p["mo"], p["d"]), p["clock"])
        md = F.when(this > ntz(as_of + timedelta(days=1)),
                    _moment(_day(year - 1, p["mo"], p["d"]), p["clock"])).otherwise(this)
        near = _moment(F.coalesce(seen, now).cast("date"), p["clock"])
        bare = (F.when(seen.isNotNull() & (near < seen - half), near + one)
                .when(seen.isNull() & (near > now), near - one).otherwise(near))
        return (F.when(p["shape"] == "abs", _moment(p["day"], p["clock"])).when(p["shape"] == "md", md)
                .when(p["shape"] == "clock", bare))

    return let(label_parts(c, as_of), settle)


def parse_window(spec: str, as_of: datetime) -> tuple[datetime | None, datetime | None]:
    """Inclusive bounds of a time-window spec: '', ``7d``, ``2026-03`` or ``a~b`` with either side open.
    A job parameter, so it is read on the driver and used as literals."""
    spec = (spec or "").strip()
    if not spec:
        return None, None
    days = re.fullmatch(r"(\d+)\s*[dD天]", spec)
    if days:
        midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
        return midnight - timedelta(days=int(days[1]) - 1), as_of
    month = re.fullmatch(r"(\d{4})-(\d{1,2})", spec)
    if month:
        start = datetime(int(month[1]), int(month[2]), 1)
        following = (start + timedelta(days=32)).replace(day=1)
        return start, following - timedelta(seconds=1)
    a, tilde, b = (x.strip() for x in spec.partition("~"))
    if tilde and (a or b):
        try:
            start = datetime.strptime(a, "%Y-%m-%d") if a else None
            end = datetime.strptime(b, "%Y-%m-%d") + timedelta(days=1, seconds=-1) if b else None
            return start, end
        except ValueError:
            pass
    raise ValueError(f"cannot read time window {spec!r}; try 7d, 2026-03 or 2026-01-01~2026-08-27")
