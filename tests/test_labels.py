import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatloom.functions.text import is_voice_mark, voice_seconds
from chatloom.functions.timelabel import is_time_label, parse_time_label, parse_window
from chatloom.operators import labels as lb
from chatloom.operators.filters import filter_time_window, route_blocks, take_until

NOW = datetime(2026, 8, 27, 20, 0)


def test_label_shapes(evaluate):
    yes = ["14:30", "14:30:25", "昨天 14:30", "前天 09:05", "星期二 14:30", "周三 08:00", "2026年8月5日", "2026年8月5日 14:30",
           "8月5日 14:30", " 14:30 ", "2026 年 8 月 5 日"]
    no = ["开会时间是14:30分", "收到", "2026年8月", "张三：你好", "昨天 14:30:25", "星期二", ""]
    assert evaluate(is_time_label("x"), yes + no) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("text,want", [
    ("2026年8月5日 14:30", datetime(2026, 8, 5, 14, 30)), ("3月16日", datetime(2026, 3, 16)), ("12月30日", datetime(2025, 12, 30)),
    ("星期二 10:00", datetime(2026, 8, 25, 10)), ("星期四 10:00", datetime(2026, 8, 20, 10)), ("昨天 14:30", datetime(2026, 8, 26, 14, 30)),
    ("昨天 14:30:25", datetime(2026, 8, 26, 14, 30, 25)), ("前天 09:05", datetime(2026, 8, 25, 9, 5)), ("10:00", datetime(2026, 8, 27, 10)),
    ("23:00", datetime(2026, 8, 26, 23)), ("周日 08:00", datetime(2026, 8, 23, 8)), ("星期天 08:00", datetime(2026, 8, 23, 8)),
    ("8月28日 19:00", datetime(2026, 8, 28, 19)), ("8月28日 21:00", datetime(2025, 8, 28, 21)),
    ("2005年7月25日", None), ("1999年12月31日", None), ("2027年1月1日", None), ("24:41", None), ("昨天 24:15", None), ("星期二 25:00", None),
    ("12:60", None), ("99:99", None), ("2月30日", None), ("2026年2月29日", None), ("收到", None), ("", None), ("昨天", None)])
def test_parse_label(evaluate, text, want):
    assert evaluate(parse_time_label("x", NOW), [text]) == [want]


def test_parse_label_after_another(evaluate):
    seen = F.lit("2025-12-31 23:00:00").cast("timestamp_ntz")
    got = evaluate(parse_time_label("x", NOW, seen), ["01:00", "22:00", "11:00", "1月2日", "2月29日"])
    assert got == [datetime(2026, 1, 1, 1), datetime(2025, 12, 31, 22), datetime(2025, 12, 31, 11), datetime(2025, 1, 2), None]


def test_voice_marks(evaluate):
    texts = ["12''", '12"', "60″", "5'", "12", "12:30", "abc''"]
    assert evaluate(voice_seconds("x"), texts) == [12, 12, 60, 5, None, None, None]
    assert evaluate(is_voice_mark("x"), texts) == [True] * 4 + [False] * 3


def test_windows():
    assert parse_window("", NOW) == (None, None)
    assert parse_window("7d", NOW) == (datetime(2026, 8, 21), NOW)
    assert parse_window("30D", NOW)[0] == datetime(2026, 7, 29)
    assert parse_window("2026-03", NOW) == (datetime(2026, 3, 1), datetime(2026, 3, 31, 23, 59, 59))
    assert parse_window("2026-12", NOW)[1] == datetime(2026, 12, 31, 23, 59, 59)
    assert parse_window("2026-01-01~2026-08-27", NOW) == (datetime(2026, 1, 1), datetime(2026, 8, 27, 23, 59, 59))
    assert parse_window("2026-01-01~", NOW) == (datetime(2026, 1, 1), None)
    assert parse_window("~2026-01-01", NOW) == (None, datetime(2026, 1, 1, 23, 59, 59))
    for bad in (" nonsense ", "~", "2026"):
        with pytest.raises(ValueError):
            parse_window(bad, NOW)


def test_window_filter_keeps_undated_rows_and_both_ends(spark):
    m = spark.createDataFrame([(1, datetime(2026, 3, 1)), (2, datetime(2026, 3, 31, 23, 59, 59)), (3, datetime(2026, 4, 1)), (4, None)],
                              "i int, ts timestamp_ntz")
    assert [r.i for r in filter_time_window(m, "2026-03", NOW).orderBy("i").collect()] == [1, 2, 4]
    assert filter_time_window(m, "2026", NOW).count() == 4
    assert filter_time_window(m, "", NOW).count() == 4


def test_route(spark):
    b = spark.createDataFrame([("12:30",), ("12''",), ("你好",)], "text string")
    assert [r.route for r in route_blocks(b).collect()] == ["time", "voice", "text"]


# --- brute force: the same rules, one label at a time, with datetime ---
def fold(labels, now):
    seen, out = None, []
    for shape, value in labels:
        t = None
        if shape == "full":
            t = value if 2011 <= value.year <= now.year else None
        elif shape == "md":
            mo, d, clock = value
            for y in ([seen.year if seen else now.year]):
                try:
                    t = datetime(y, mo, d) + clock
                    if t > now + timedelta(days=1):
                        t = datetime(y - 1, mo, d) + clock
                except ValueError:
                    t = None
        elif shape == "clock":
            base = seen or now
            t = datetime(base.year, base.month, base.day) + value
            if seen is not None:
                t += timedelta(days=1) if t < seen - timedelta(hours=12) else timedelta()
            elif t > now:
                t -= timedelta(days=1)
        seen = t or seen
        out.append(seen)
    return out


def render(shape, value):
    if shape == "full":
        return f"{value.year}年{value.month}月{value.day}日 {value:%H:%M:%S}"
    if shape == "md":
        mo, d, clock = value
        return f"{mo}月{d}日 {clock.seconds // 3600:02d}:{clock.seconds // 60 % 60:02d}"
    if shape == "clock":
        return f"{value.seconds // 3600:02d}:{value.seconds // 60 % 60:02d}"
    return value


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_resolve_labels_against_fold(spark, width):
    rng = random.Random(width)
    rows, want = [], {}
    for chat in range(150):
        now = NOW
        labels = []
        weights = rng.choice([(1, 3, 8, 1), (0, 4, 8, 1), (0, 1, 30, 1), (1, 6, 3, 1), (0, 8, 1, 0)])
        for _ in range(rng.randint(1, 40)):
            shape = rng.choices(["full", "md", "clock", "junk"], weights)[0]
            clock = timedelta(hours=rng.choice([0, 1, 9, 13, 23]), minutes=rng.randint(0, 59))
            value = {"full": datetime(rng.choice([2005, 2012, 2023, 2024, 2025, 2026]), rng.choice([2, 12]), rng.randint(1, 28)) + clock,
                     "md": (*rng.choice([(2, 29), (2, 28), (12, 31), (12, 30), (8, 27), (8, 28), (8, 29), (1, 1)]), clock),
                     "clock": clock, "junk": rng.choice(["99:99", "2月30日", "24:41"])}[shape]
            labels.append((shape, value))
        for i, (label, t) in enumerate(zip(labels, fold(labels, now))):
            rows.append((chat, i // 2, i % 2 * 10, render(*label)))
            want[chat, i // 2, i % 2 * 10] = t
    df = spark.createDataFrame(rows, "chat int, screen_idx int, cy int, text string")
    got = {(r.chat, r.screen_idx, r.cy): r.ts for r in lb.resolve_labels(df, NOW, ["chat"], width=width).collect()}
    assert got == want


def test_assign_times(spark):
    labels = spark.createDataFrame([("a", 0, 62, "2026年8月5日"), ("a", 0, 232, "14:30")], "chat string, screen_idx int, cy int, text string")
    m = spark.createDataFrame([("a", 0, 60), ("a", 0, 62), ("a", 0, 100), ("a", 0, 300), ("a", 3000, 5)], "chat string, screen_idx int, top int")
    out = lb.assign_times(m, lb.resolve_labels(labels, NOW, ["chat"]), ["chat"]).orderBy("screen_idx", "top").collect()
    assert [(r.time_label, r.ts) for r in out] == [
        ("", None), ("", None), ("2026年8月5日", datetime(2026, 8, 5)), ("14:30", datetime(2026, 8, 5, 14, 30)),
        ("14:30", datetime(2026, 8, 5, 14, 30))]


def test_take_until_keeps_the_stop_screen(spark):
    s = spark.createDataFrame([("a", i, datetime(2026, 1, i + 1) if i != 1 else None) for i in range(6)],
                              "chat string, screen_idx int, earliest timestamp_ntz")
    out = take_until(s, datetime(2026, 1, 3, 23, 59, 59), ["chat"])
    assert sorted(r.screen_idx for r in out.collect()) == [0, 1, 2, 3]


def test_results_do_not_depend_on_the_session_zone(spark):
    """A zone whose clocks jump back in this night must not disturb order or gaps."""
    from chatloom.operators.activity import activity_pauses
    t0 = datetime(2026, 10, 25, 1, 50)
    ev = spark.createDataFrame([("u", t0 + timedelta(minutes=20 * i)) for i in range(6)], "user string, ts timestamp_ntz")
    labels = spark.createDataFrame([("a", 0, 1, "2026年8月5日 14:30")], "chat string, screen_idx int, cy int, text string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        p = activity_pauses(ev, ["user"], 1500).collect()
        assert [(r.pause_start, r.resume_at, r.n_events) for r in p] == [(t0, t0 + timedelta(minutes=125), 6)]
        assert lb.resolve_labels(labels, NOW, ["chat"]).first().ts == datetime(2026, 8, 5, 14, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("width", [1, 500, 100_000])
def test_years_that_clocks_alone_reach(spark, width):
    """Eight years of clocks past ``as_of``, with month-day labels in between; a chat without a name has them too."""
    rows, want = [], {}
    for chat in ("a", None):
        labels = [("full", datetime(2026, 1, 5, 9))] if chat else []
        for i in range(5900):
            at = timedelta(hours=23 if i % 2 else 1)
            labels.append(("md", (12, 28, at)) if i % 1471 == 1470 else ("md", (2, 29, at)) if i % 997 == 996 else ("clock", at))
        for i, (label, t) in enumerate(zip(labels, fold(labels, NOW))):
            rows.append((chat, i, 0, render(*label)))
            want[chat, i] = t
    assert max(want.values()).year >= NOW.year + 3
    df = spark.createDataFrame(rows, "chat string, screen_idx int, cy int, text string").repartition(5)
    got = {(r.chat, r.screen_idx): r.ts for r in lb.resolve_labels(df, NOW, ["chat"], width=width).collect()}
    assert got == want


def test_a_chat_without_a_name_keeps_its_year(spark):
    rows = [(None, 0, 0, "2024年3月5日 10:00"), (None, 5, 0, "11:00"), ("b", 0, 0, "10:00")]
    df = spark.createDataFrame(rows, "chat string, screen_idx int, cy int, text string")
    for width in (2, 1024):
        got = {(r.chat, r.screen_idx): r.ts for r in lb.resolve_labels(df, NOW, ["chat"], width=width).collect()}
        assert got[None, 5] == datetime(2024, 3, 5, 11)
