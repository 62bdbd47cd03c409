"""When two readings are the same chat name. The pandas UDF below is for pairs that already passed the
native bounds of ``operators.entities``."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import constants as K
from .memo import remembered
from .text import as_col, characters, norm_name

_PUNCTUATION = re.compile(K.NAME_PUNCTUATION.removeprefix("(?U)"))
_LONG_NUMBER = re.compile(r"\d{6,}")


def _bare(name: str) -> str:
    return _PUNCTUATION.sub("", name)


_plain = remembered(_bare, 1 << 15)
_held = remembered(Counter, 1 << 15)


def _common(x: str, y: str) -> int:
    """How many characters two names have in common, repeats counted."""
    a, b = _held(x), _held(y)
    if len(a) > len(b):
        a, b = b, a
    return sum([min(n, b[c]) for c, n in a.items() if c in b])


def _alike(first: str, second: str, threshold: float) -> bool:
    """Sequence ratio against a threshold. Matched characters are common characters, so too few of those
    settle it without the ratio."""
    size = len(first) + len(second)
    if len(second) < 200 and (first in second or second in first):      # all of the shorter one matches; from 200 on frequent characters do not count
        return 2 * min(len(first), len(second)) / size >= threshold
    if 2 * _common(first, second) / size < threshold:
        return False
    return SequenceMatcher(None, first, second).ratio() >= threshold


def numbers_agree(one: str, other: str) -> bool:
    """A number of six or more digits on one side holds one of the other side."""
    for pair in product(_LONG_NUMBER.findall(one), _LONG_NUMBER.findall(other)):
        small, large = sorted(pair, key=len)
        if small in large:
            return True
    return False


def digit_grams(name: str) -> set[str]:
    """Six digits in a row. Names whose numbers agree share some."""
    return {run[i:i + 6] for run in _LONG_NUMBER.findall(name) for i in range(len(run) - 5)}


def _close(x: str, y: str, threshold: float) -> bool:
    slack = max(2, len(x) // 3)     # a third of the first name: the order of arguments matters
    return len(x) - slack <= len(y) <= len(x) + slack and _alike(x, y, threshold)


def _inside(small: str, large: str, threshold: float) -> bool:
    width = len(small)
    if width < 4 or width >= len(large) or _common(small, large) / width < threshold:
        return False
    # characters of the small name the window still lacks, kept up to date while the window moves
    lacking = Counter(small)
    lacking.subtract(large[:width])
    common = width - sum(v for v in lacking.values() if v > 0)
    for end in range(width, len(large) + 1):
        window = large[end - width:end]
        if common / width >= threshold and SequenceMatcher(None, small, window).ratio() >= threshold:
            return True
        if end < len(large):
            lacking[window[0]] += 1
            common -= lacking[window[0]] > 0
            common += lacking[large[end]] > 0
            lacking[large[end]] -= 1
    return False


def _dropped(small: str, large: str) -> bool:
    if len(small) < 4 or small[0] != large[:1] or len(large) - len(small) not in range(1, 7):
        return False
    at = 0
    for ch in small:
        at = large.find(ch, at) + 1
        if at == 0:
            return False
    return True


def fuzzy_same(one: str, other: str, threshold: float = K.FUZZY_RATIO) -> bool:
    """Close in length and sequence, or with a long number in common."""
    x, y = _plain(one), _plain(other)
    return len(x) > 1 and len(y) > 1 and (numbers_agree(one, other) or _close(x, y, threshold))


def window_contains(cut: str, full: str, threshold: float = K.WINDOW_RATIO) -> bool:
    """Some stretch of the longer name resembles the whole shorter one (a cut name)."""
    return _inside(_plain(cut), _plain(full), threshold)


def subseq_drop(short: str, long: str) -> bool:
    """The shorter name is the longer one with one to six characters left out, first one kept."""
    return _dropped(_plain(short), _plain(long))


def same_reading(one: str, other: str, ratio: float = K.FUZZY_RATIO, window: float = K.WINDOW_RATIO) -> bool:
    """Not symmetric: ratio and length bound look at the first argument."""
    if fuzzy_same(one, other, ratio):
        return True
    x, y = _plain(one), _plain(other)
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    return _dropped(small, large) or _inside(small, large, window)


class Traits:
    """What tells most names apart at once: the characters numbered where they repeat, and six-digit grams."""

    __slots__ = ("name", "held", "size", "grams")

    def __init__(self, name: str):
        seen, plain = {}, _bare(name)
        self.name, self.size, self.grams = name, len(plain), digit_grams(name)
        held = []
        for c in plain:
            k = seen[c] = seen.get(c, 0) + 1
            held.append(c if k == 1 else (c, k))
        self.held = frozenset(held)

    def near(self, other: Traits) -> bool:
        """A bound: whether the names can be variants, whichever comes first."""
        if self.held.isdisjoint(other.held):
            return False
        short, long = (self.size, other.size) if self.size < other.size else (other.size, self.size)
        common = len(self.held & other.held) + 1e-9
        if short >= 2 and long - short <= max(2, long // 3) and common >= K.FUZZY_RATIO / 2 * (short + long):
            return True
        return short >= 4 and long > short and common >= K.WINDOW_RATIO * short or not self.grams.isdisjoint(other.grams)


traits = remembered(Traits, 1 << 12)


class Gathered:
    """A few names by number, to be searched for those that can be variants of a name."""

    def __init__(self, names=()):
        self.of, self.holding = {}, {}
        for no, name in names:
            self.add(no, traits(name))

    def add(self, no: int, one: Traits) -> None:
        self.of[no] = one
        for c in one.held:
            self.holding.setdefault(c, []).append(no)

    def drop(self, no: int) -> None:
        if no not in self.of:
            return
        for c in self.of.pop(no).held:
            left = self.holding[c]
            left.remove(no)
            if not left:
                del self.holding[c]

    def near(self, one: Traits) -> list[int]:
        found = set()
        for c in one.held:
            if c in self.holding:
                found.update(self.holding[c])
        return [no for no in sorted(found) if one.near(self.of[no])]


@F.pandas_udf(BooleanType())
def _score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and same_reading(x, y) for x, y in zip(a, b)], dtype="bool")


@F.pandas_udf(BooleanType())
def _score_both(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_reading(x, y) or same_reading(y, x) for x, y in zip(a, b)], dtype="bool")


@F.pandas_udf(BooleanType())
def is_fuzzy_same(a: pd.Series, b: pd.Series) -> pd.Series:
    """``fuzzy_same`` of two columns."""
    return pd.Series([x is not None and y is not None and fuzzy_same(x, y) for x, y in zip(a, b)], dtype="bool")


@F.pandas_udf(BooleanType())
def is_window_contained(cut: pd.Series, full: pd.Series) -> pd.Series:
    """``window_contains`` of two columns."""
    return pd.Series([x is not None and y is not None and window_contains(x, y) for x, y in zip(cut, full)], dtype="bool")


# Declared non-deterministic only to stay where it is written: the optimizer would otherwise move it below the
# cheap bounds and the removal of repeated pairs.
name_variant = _score.asNondeterministic()
either_way = _score_both.asNondeterministic()


def variant_of_any(name: Column | str, wanted: list[str]) -> Column:
    """Whether a name is a reading of one of a few requested names (a job parameter)."""
    @F.pandas_udf(BooleanType())
    def hit(names: pd.Series) -> pd.Series:
        return pd.Series([n is not None and any(same_reading(n, w) for w in wanted) for n in names], dtype="bool")

    return hit.asNondeterministic()(as_col(name))


def shared_digit_run(a: Column | str, b: Column | str) -> Column:
    """Native form of ``numbers_agree``."""
    runs = lambda c: F.regexp_extract_all(as_col(c), F.lit(r"(?U)\d{6,}"), F.lit(0))
    return F.exists(runs(a), lambda x: F.exists(runs(b), lambda y: x.contains(y) | y.contains(x)))


def is_subseq_drop(short: Column | str, long: Column | str) -> Column:
    """Native form of ``subseq_drop``: a cursor walks the longer name."""
    s, l = norm_name(short), norm_name(long)
    gap = F.length(l) - F.length(s)

    def step(at: Column, ch: Column) -> Column:
        found = F.call_function("locate", ch, l, at + 1)
        return F.when(at < 0, at).when(found == 0, F.lit(-1)).otherwise(found)

    walk = F.aggregate(characters(s), F.lit(0), step)
    return ((F.length(s) >= 4) & gap.between(1, 6) & (F.substring(s, 1, 1) == F.substring(l, 1, 1)) & (walk > 0))
