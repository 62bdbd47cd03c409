"""Time labels along a chat: resolving them and handing them to messages."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FIRST_YEAR
from ..functions.timelabel import from_wall_micros, label_parts, parse_time_label
from ..session import settle
from .scan import SCREENS_PER_SLICE, carry_scan, fold_sorted, key_ddl, null_safe_join, slice_of

DAY = 86400
EPOCH = date(1970, 1, 1).toordinal()


def earliest_label(labels: DataFrame, as_of: datetime, keys: list[str], screen: str = "screen_idx") -> DataFrame:
    """The earliest readable label of each screen."""
    return (labels.withColumn("_t", parse_time_label("text", as_of)).filter(F.col("_t").isNotNull())
            .groupBy(*keys, screen).agg(F.min("_t").alias("earliest")))


class _Clock:
    """Moves one chat's last known time over its labels. Times are (day number, second of day); None before
    the first readable label."""

    def __init__(self, as_of: datetime):
        self.year = as_of.year
        self.today = as_of.date().toordinal() - EPOCH
        self.now = as_of.hour * 3600 + as_of.minute * 60 + as_of.second
        self.horizon = (self.today + 1, self.now)

    def clock(self, last, sod, further_days=0, end=None):
        """A bare clock, or a run of them that adds ``further_days`` and ends at ``end``."""
        if last is None:
            day = self.today - (sod > self.now)
        else:
            day = last[0] + (sod < last[1] - DAY // 2)
        return day + further_days, sod if end is None else end

    def month_day(self, last, mo, d, sod):
        y = self.year if last is None else date.fromordinal(last[0] + EPOCH).year
        try:
            t = (date(y, mo, d).toordinal() - EPOCH, sod)
            if t > self.horizon:
                t = (date(y - 1, mo, d).toordinal() - EPOCH, sod)
            return t
        except ValueError:      # 29 February of a common year: the label stays unread
            return last

    def step(self, last, shape, day, mo, d, sod):
        if shape == "abs":
            return int(day), int(sod)
        if shape == "md":
            return self.month_day(last, int(mo), int(d), int(sod))
        if shape == "clock":
            return self.clock(last, int(sod))
        return last


def _secs(t):
    return None if t is None else t[0] * DAY + t[1]


def _pair(secs):
    return None if secs is None or secs != secs else divmod(int(secs), DAY)


class _Summary:
    """What a slice does to the time it receives.

    A slice with an absolute label ends at a fixed time. Otherwise the time it receives matters only through
    the year at its first month-day label; what stands before that label is kept as a short program in
    which each run of bare clocks is one entry. From there on it is a function of the year, given piece by piece: by a
    table of the years ``low`` to ``high`` that come with its rows.
    """

    def __init__(self, as_of):
        self.clk = _Clock(as_of)
        self.fixed, self.has_fixed = None, False
        self.program, self.states = [], None

    def row(self, values):
        shape, day, mo, d, sod = values[:5]
        if shape == "abs":
            self.has_fixed, self.fixed = True, self.clk.step(None, *values[:5])
        elif self.has_fixed:
            self.fixed = self.clk.step(self.fixed, *values[:5])
        elif self.states is not None:
            # years that have reached the same time stay together from here on
            moved = {}
            for t, years in self.states.items():
                moved.setdefault(self.clk.step(t, *values[:5]), []).extend(years)
            self.states = moved
        elif shape == "md" and (mo, d) != (2, 29):
            self.states = {}
            for y in range(int(values[-2]), int(values[-1]) + 1):
                t = self.clk.month_day((date(y, 1, 1).toordinal() - EPOCH, 0), int(mo), int(d), int(sod))
                self.states.setdefault(t, []).append(y)
        elif shape == "md":
            self.program.append([1, int(mo), int(d), int(sod)])
        elif shape == "clock":
            sod = int(sod)
            if self.program and self.program[-1][0] == 0:
                run = self.program[-1]
                run[2] += sod < run[3] - DAY // 2
                run[3] = sod
            else:
                self.program.append([0, sod, 0, sod])
        return ()

    def end(self):
        by_year = None
        if not self.has_fixed and self.states is not None:
            by_year = {y: _secs(t) for t, years in self.states.items() for y in years}
        return [(_secs(self.fixed) if self.has_fixed else None, self.program,
                 None if by_year is None else list(by_year.items()))]


class _Carry:
    """Runs over slice summaries and tells each slice the time it receives. A slice may come in several rows with different
    years. Where a year is lacking the walk ends with a row that names it."""

    def __init__(self, as_of):
        self.clk, self.last, self.stuck = _Clock(as_of), None, False
        self.piece, self.held, self.years = None, None, {}

    def row(self, values):
        piece, fixed, program, by_year = values
        done = self._closed() if piece != self.piece else []
        self.piece, self.held = piece, (fixed, program, by_year is not None)
        self.years.update(by_year if by_year is not None else ())
        return done

    def _closed(self):
        if self.held is None or self.stuck:
            return []
        (fixed, program, branches), years, received = self.held, self.years, self.last
        self.held, self.years = None, {}
        if _pair(fixed) is not None:
            self.last = _pair(fixed)
            return [(self.piece, _secs(received), None)]
        t = self.last
        for kind, a, b, c in program:
            t = self.clk.clock(t, a, b, c) if kind == 0 else self.clk.month_day(t, a, b, c)
        if branches:
            y = self.clk.year if t is None else date.fromordinal(t[0] + EPOCH).year
            if y not in years:
                self.stuck = True
                return [(self.piece, _secs(received), y)]
            t = _pair(years[y])
        self.last = t
        return [(self.piece, _secs(received), None)]

    def end(self):
        return self._closed()


class _Resolve:
    """Replays a slice from the time it receives."""

    def __init__(self, as_of):
        self.clk, self.last, self.started = _Clock(as_of), None, False

    def row(self, values):
        *parts, received, screen, cy, text = values
        if not self.started:
            self.last, self.started = _pair(received), True
        self.last = self.clk.step(self.last, *parts)
        return [(screen, cy, text, _secs(self.last))]

    def end(self):
        return ()


def resolve_labels(labels: DataFrame, as_of: datetime, keys: list[str], screen: str = "screen_idx",
                   cy: str = "cy", width: int = SCREENS_PER_SLICE) -> DataFrame:
    """The absolute time in force from each label on (``ts``).

    A bare clock takes the date before it, one day on if it is more than twelve hours earlier; a month-day
    label takes the year before it; an unreadable label keeps the time before it. This is a fold, cut
    into slices of the screen axis: each slice is summarised, the summaries are walked per chat, and every
    slice is replayed from what it receives. Only a few integers per label pass through Python.

    Summaries cover the years that labels name. Clocks alone can lead beyond; where a walk asks for a year that a slice lacks, that
    slice and those after it in the chat are summarised again for the years around it, twice as many each time, and the walk is
    repeated. The result does not depend on ``width``. A NULL key is a chat of its own.
    """
    sliced, ddl = [*keys, "_slice"], key_ddl(labels, keys)
    p = F.col("_p")
    rows = (labels.select(*keys, screen, cy, "text", slice_of(screen, width).alias("_slice"),
                          label_parts("text", as_of).alias("_p"))
            .select(*sliced, p["shape"].alias("shape"), F.unix_date(p["day"]).alias("day"), p["mo"].alias("mo"),
                    p["d"].alias("d"), p["clock"].alias("clock"), screen, cy, "text")
            .repartition(*sliced))

    def summarised(some: DataFrame, low: Column, high: Column) -> DataFrame:
        some = some.select(*rows.columns, low.cast("int").alias("low"), high.cast("int").alias("high"))
        return settle(fold_sorted(some, sliced, [screen, cy, "text"], lambda: _Summary(as_of),
                                  f"{ddl}, _slice bigint, fixed bigint, program array<array<int>>, by_year array<array<bigint>>"), "slices")

    summary = summarised(rows, F.lit(min(FIRST_YEAR, as_of.year - 1)), F.lit(as_of.year + 2))
    reach = 8
    while True:
        carry = settle(fold_sorted(summary, keys, ["_slice"], lambda: _Carry(as_of),
                                   f"{ddl}, _slice bigint, received bigint, missing int"), "carry")
        stuck = carry.filter("missing is not null").select(*keys, F.col("_slice").alias("_from"), "missing")
        if stuck.isEmpty():
            break
        later = null_safe_join(rows, stuck, keys).filter("_slice >= _from")
        summary = summary.unionAll(summarised(later, F.greatest(F.col("missing") - reach, F.lit(1)), F.least(F.col("missing") + reach, F.lit(9998))))
        reach *= 2
    ready = null_safe_join(rows, carry.drop("missing"), sliced, "left").select(
        *sliced, "shape", "day", "mo", "d", "clock", "received", screen, cy, "text")
    times = fold_sorted(ready, sliced, [screen, cy, "text"], lambda: _Resolve(as_of),
                        f"{ddl}, _slice bigint, {key_ddl(labels, [screen, cy])}, text string, _secs bigint")
    return times.select(*keys, screen, cy, "text",
                        from_wall_micros(F.col("_secs") * 1000000).alias("ts"))


def assign_times(messages: DataFrame, resolved: DataFrame, keys: list[str], screen: str = "screen_idx",
                 top: str = "top", cy: str = "cy") -> DataFrame:
    """As-of join: each message takes text and time of the nearest label strictly above it, carried across
    screens. Labels and messages are merged into one ordered stream and the last label is carried
    forward, slice by slice; nothing is matched pairwise."""
    label = F.struct(F.col("text").alias("label"), F.col("ts").alias("ts"))
    marks = resolved.select(*keys, F.col(screen), F.col(cy).cast("double").alias("_y"), F.lit(1).alias("_is_label"),
                            label.alias("_label"))
    rows = messages.select("*", F.col(top).cast("double").alias("_y"), F.lit(0).alias("_is_label"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # a label on the same height as a message does not lie above it: the message sorts first
    seen = carry_scan(both, keys, slice_of(screen, SCREENS_PER_SLICE),
                      [F.col(screen), F.col("_y"), F.col("_is_label")], last={"_seen": F.col("_label")})
    return (seen.filter(F.col("_is_label") == 0)
            .withColumn("time_label", F.coalesce("_seen.label", F.lit(""))).withColumn("ts", F.col("_seen.ts"))
            .drop("_y", "_is_label", "_label", "_seen"))
