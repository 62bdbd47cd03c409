"""List stamps: the short last-activity mark in a chat list."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import as_col
from .timelabel import parse_window


def norm_stamp_digits(c: Column | str) -> Column:
    """Undo the usual digit misreadings (U and O for 0; I, l and | for 1) and drop white space."""
    return F.translate(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"(?U)\s+", ""),
                       "UOIl|", "00111")


def is_stamp(c: Column | str) -> Column:
    c = as_col(c)
    return c.rlike(K.STAMP) | norm_stamp_digits(c).rlike(K.STAMP_AFTER_REPAIR)


def _date(y: Column, m: Column, d: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(y, m, d, zero, zero, zero.cast("decimal(8,6)")).cast("date")


def stamp_older_than(c: Column | str, cutoff: date | Column, as_of: date) -> Column:
    """Whether a stamp lies before ``cutoff``: true, false, or NULL where it cannot be told.

    Never filter with ``~older``: NULL means keep. Use ``older`` (drop) or ``older = false`` (proof).
    """
    s = norm_stamp_digits(c)
    cut = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    today = F.lit(as_of)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(s, pattern, group).try_cast("int")

    y, mo = part(K.YEAR_STAMP, 1), part(K.YEAR_STAMP, 2)
    d = F.coalesce(part(K.YEAR_STAMP, 3), F.lit(1))
    one = F.lit(1)
    dated = F.coalesce(_date(y, mo, d), _date(y, mo, one), _date(y, one, one)) < cut
    only_year = F.regexp_extract(s, r"^((?:19|20)\d{2})$", 1).try_cast("int")
    by_year = F.when(only_year != F.year(cut), only_year < F.year(cut))
    smo, sd = part(K.MONTH_DAY_STAMP, 1), part(K.MONTH_DAY_STAMP, 2)
    this_year = _date(F.year(today), smo, sd)
    # A day of this year that has not come yet can only be left over from last year.
    month_day = F.when(this_year > today, _date(F.year(today) - 1, smo, sd)).otherwise(this_year) < cut
    return (F.when(s.rlike(K.YEAR_STAMP), dated)
            .when(only_year.isNotNull(), by_year)
            .when(s.rlike(K.WITHIN_WEEK_STAMP), F.date_sub(today, 6) < cut)
            .when(s.rlike(K.MONTH_DAY_STAMP), month_day))


def window_cutoff(spec: str, as_of: datetime) -> date | None:
    """First day a chat must reach to be selected: a year token means 1 January of that year."""
    year = re.fullmatch(r"(20\d{2})", (spec or "").strip())
    if year:
        return date(int(year[1]), 1, 1)
    start, _ = parse_window(spec, as_of)
    return start.date() if start else None
