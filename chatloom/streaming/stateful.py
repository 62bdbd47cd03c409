"""Operators with their own state: overlap removal, label carry and the running name list.

Overlap removal keeps the texts of the last two screens, labels one time, names the last sixteen and every name that was put
on the list, in buckets. Rows of a key are put in screen order inside a batch; screens must arrive in order across batches. Overlap
removal hands out what comes too late with ``late = true``; labels and names take late rows as they come, without a mark.
"""

from __future__ import annotations

import zlib
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions import constants as K
from ..functions.timelabel import from_wall_micros, label_parts
from ..operators.entities import NameList
from ..operators.labels import _Clock
from ..operators.scan import key_ddl


def _batch(rows, order: list[str], columns: list[str]) -> list[tuple]:
    """Rows of one key in this batch, in order, as tuples. Most keys bring a handful, so no frame is built
    beyond the ones that arrive."""
    found = [t for pdf in rows for t in zip(*[pdf[c].tolist() for c in columns])]
    at = [columns.index(c) for c in order]
    return sorted(found, key=lambda t: [t[i] for i in at])


class _Overlap(StatefulProcessor):
    """Remembers which texts stood on the last ``window - 1`` screens."""

    def __init__(self, columns, window):
        self.columns, self.window = columns, window

    def init(self, handle):
        self.recent = handle.getValueState("recent", T.StructType([
            T.StructField("top", T.LongType()), T.StructField("screens", T.ArrayType(T.LongType())),
            T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("ranks", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key, rows, timers):
        top, last = None, {}
        known = self.recent.get()
        if known:
            top, screens, texts, ranks = known
            last = {(t, r): s for s, t, r in zip(screens, texts, ranks)}
        start, out = top, []
        for row in _batch(rows, ["screen_idx"], self.columns):
            fp, rank, screen, _ = row[-4:]
            what = (fp, rank)
            before = last.get(what)
            late = start is not None and (screen < start or before == screen)
            if late or before is None or screen - before >= self.window:
                out.append((*row, late))
            if not late:
                last[what] = screen
                top = screen if top is None else max(top, screen)
        kept = [(s, t, r) for (t, r), s in last.items() if top - s < self.window]
        self.recent.update((top, *([list(c) for c in zip(*kept)] if kept else ([], [], []))))
        if out:
            yield pd.DataFrame(out, columns=[*self.columns, "late"])

    def close(self):
        pass


def stream_dedup_overlap(stream: DataFrame, keys: list[str], window: int = K.DEDUP_SCREENS, spread: int = 4) -> DataFrame:
    """Streaming ``dedup_overlap`` on (keys, fp, rank, screen_idx, text). Repeats refresh the last screen, so
    ``dropDuplicatesWithinWatermark`` would not do. Texts of a chat never depend on each other, so each
    chat is split by text into ``spread`` parts: raise it for streams with one very busy chat."""
    cols = [*keys, "fp", "rank", "screen_idx", "text"]
    s = stream.select(*cols, F.pmod(F.xxhash64("fp"), F.lit(spread)).alias("_part"))
    return s.groupBy(*keys, "_part").transformWithStateInPandas(
        _Overlap(cols, window), f"{key_ddl(s, cols)}, late boolean", "append", "none")


class _Labels(StatefulProcessor):
    def __init__(self, as_of):
        self.as_of = as_of

    def init(self, handle):
        self.last = handle.getValueState("last", T.StructType([
            T.StructField("day", T.LongType()), T.StructField("sod", T.LongType())]))

    def handleInputRows(self, key, rows, timers):
        clk = _Clock(self.as_of)
        known = self.last.get()
        last = tuple(known) if known else None
        out = []
        for screen, cy, text, *parts in _batch(rows, ["screen_idx", "cy", "text"], [
                "screen_idx", "cy", "text", "shape", "day", "mo", "d", "clock"]):
            last = clk.step(last, *parts)
            secs = None if last is None else last[0] * 86400 + last[1]
            out.append((*key, screen, cy, text, secs))
        if last is not None:
            self.last.update((int(last[0]), int(last[1])))
        if out:
            yield pd.DataFrame(out, columns=[f"k{i}" for i in range(len(key))] + ["screen_idx", "cy", "text", "secs"])

    def close(self):
        pass


def stream_resolve_labels(stream: DataFrame, as_of: datetime, keys: list[str]) -> DataFrame:
    """Streaming ``resolve_labels``: one date and time of day per chat."""
    p = F.col("_p")
    s = (stream.select(*keys, "screen_idx", "cy", "text", label_parts("text", as_of).alias("_p"))
         .select(*keys, "screen_idx", "cy", "text", p["shape"].alias("shape"), F.unix_date(p["day"]).alias("day"),
                 p["mo"].alias("mo"), p["d"].alias("d"), p["clock"].alias("clock")))
    ks = ", ".join(f"k{i} {s.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    out = s.groupBy(*keys).transformWithStateInPandas(
        _Labels(as_of), f"{ks}, {key_ddl(s, ['screen_idx', 'cy'])}, text string, secs bigint", "append", "none")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "screen_idx", "cy", "text",
                      from_wall_micros(F.col("secs") * 1000000).alias("ts"))


class _Names(StatefulProcessor):
    def __init__(self, window):
        self.window = window

    def init(self, handle):
        name = T.StructType([T.StructField("name", T.StringType())])
        self.recent = handle.getListState("recent", name)
        self.before = handle.getListState("before", name)
        self.now = handle.getListState("now", name)
        # names that an earlier form of this operator put on the list, one by one
        self.seen = handle.getMapState("seen", name, T.StructType([T.StructField("n", T.IntegerType())]))
        self.put = handle.getMapState("put", T.StructType([T.StructField("bucket", T.LongType())]),
                                      T.StructType([T.StructField("names", T.ArrayType(T.StringType()))]))
        self.many = handle.getValueState("many", T.StructType([T.StructField("n", T.LongType())]))
        self.at = handle.getValueState("at", T.StructType([
            T.StructField("screen", T.LongType()), T.StructField("names", T.LongType())]))

    def handleInputRows(self, key, rows, timers):
        met, recent, before, now, screen, count = _Met(self.put, 0), [], [], [], None, 0
        known = self.at.get()
        if known:
            many = self.many.get()
            met = _Met(self.put, many[0] if many else 0, self.seen if self.seen.exists() else None)
            recent, before, now = ([r[0] for r in state.get()] for state in (self.recent, self.before, self.now))
            screen, count = known
        offset, listed, changed = count - len(recent), NameList(self.window, recent, met), {}
        batch = pd.concat([pdf[["screen_idx", "pos", "name"]] for pdf in rows], ignore_index=True)
        batch = batch.iloc[np.lexsort((batch["pos"].to_numpy(), batch["screen_idx"].to_numpy()))]
        for start in range(0, len(batch), 1 << 16):
            part = batch.iloc[start:start + (1 << 16)]
            for at, name in zip(part["screen_idx"].tolist(), part["name"].tolist()):
                if at != screen:
                    before, now, screen = now, [], int(at)
                now.append(name)
                place = listed.place(name, before)
                if place is not None:
                    changed[offset + place[0]] = name
                    if place[1]:
                        offset += listed.forget()
        for state, names in ((self.recent, listed.names), (self.before, before), (self.now, now)):
            state.put([(n,) for n in names]) if names else state.clear()
        self.at.update((screen, offset + len(listed.names)))
        if met.new:
            self.many.update((met.write(),))
        if changed:
            yield pd.DataFrame([(*key, i, n) for i, n in sorted(changed.items())],
                               columns=[f"k{i}" for i in range(len(key))] + ["no", "name"])

    def close(self):
        pass


class _Met:
    """The names that were put on a list, as a set over buckets of names in the state: one call reads or writes a bucket, and there are as many
    buckets as keep them short (linear hashing: a batch that adds names splits only as many buckets as it needs). ``many`` names are in
    the state already; what a batch adds is written at its end."""

    FULL, HELD = 64, 4096

    def __init__(self, state, many: int, older=None):
        self.state, self.many, self.older = state, many, older
        self.buckets, self.new, self.read = self._wanted(many), set(), {}

    def _wanted(self, many: int) -> int:
        return -(-many // self.FULL)

    @staticmethod
    def _home(name: str, buckets: int) -> int:
        """Bucket of a name; a bucket that is not there yet is still part of the one half as far."""
        h, full = zlib.crc32(name.encode("utf-8", "surrogatepass")), 1 << (buckets - 1).bit_length()
        return h % full if h % full < buckets else h % (full // 2)

    def _bucket(self, no: int) -> list[str]:
        if no not in self.read:
            if len(self.read) >= self.HELD:
                self.read.clear()
            found = self.state.getValue((no,))
            self.read[no] = list(found[0]) if found else []
        return self.read[no]

    def __contains__(self, name) -> bool:
        if name in self.new:
            return True
        if self.many and name in self._bucket(self._home(name, self.buckets)):
            return True
        return self.older is not None and self.older.containsKey((name,))

    def add(self, name: str) -> None:
        self.new.add(name)

    def write(self) -> int:
        """Put what is new into the state; how many names that makes."""
        total = self.many + len(self.new)
        wanted, homes = self._wanted(total), {}
        for n in self.new:
            homes.setdefault(self._home(n, wanted), []).append(n)
        # a bucket that is split deals its names out, maybe to several that are new
        split = {self._parent(no) for no in range(max(1, self.buckets), wanted)} if self.buckets else set()
        for no in sorted(split):
            dealt = {no: []}
            for n in self._bucket(no):
                dealt.setdefault(self._home(n, wanted), []).append(n)
            for to, names in dealt.items():
                self.state.updateValue((to,), (names + homes.pop(to, []),))
        for no, names in homes.items():
            self.state.updateValue((no,), ([*(self._bucket(no) if no < self.buckets else ()), *names],))
        return total

    def _parent(self, no: int) -> int:
        """The bucket of now that holds the names of one that is not there yet."""
        while no >= self.buckets:
            no -= 1 << (no.bit_length() - 1)
        return no


def stream_merge_names(stream: DataFrame, keys: list[str], window: int = 16) -> DataFrame:
    """Streaming ``merge_round_names``: the last ``window`` names and the previous screen are held per list.
    Each batch gives the positions (``no``) it filled or lengthened; the latest row of a position counts."""
    s = stream.select(*keys, "screen_idx", "pos", "name")
    ks = ", ".join(f"k{i} {s.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    out = s.groupBy(*keys).transformWithStateInPandas(
        _Names(window), f"{ks}, no bigint, name string", "append", "none")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "no", "name")
