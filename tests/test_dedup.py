import random
from collections import Counter

from pyspark.sql import functions as F

from chatloom.functions.text import is_system_notice, text_fingerprint
from chatloom.operators import dedup as dd
from chatloom.operators.filters import stop_after_idle
from chatloom.operators.scan import carry_scan, number_rows, slice_of, with_halo


def blocks(spark, rows):
    return spark.createDataFrame(rows, "chat string, screen_idx int, cy int, text string")


def texts(df):
    return [r.text for r in df.orderBy("chat", "screen_idx", "cy").collect()]


def test_overlap_cases(spark):
    assert texts(dd.compose_messages(blocks(spark, [("a", 1, 0, "今天开会"), ("a", 2, 0, "今天 开会")]), ["chat"])) == ["今天开会"]
    assert texts(dd.compose_messages(blocks(spark, [("a", 1, 0, "收到"), ("a", 9, 0, "收到")]), ["chat"])) == ["收到", "收到"]
    assert texts(dd.compose_messages(blocks(spark, [("a", 1, 0, "1"), ("a", 1, 9, "1")]), ["chat"])) == ["1", "1"]
    # refreshed by every sighting: 1, 3, 5 never lie three screens apart
    assert texts(dd.compose_messages(blocks(spark, [("a", i, 0, "x") for i in (1, 3, 5, 8)]), ["chat"])) == ["x", "x"]


def test_notices_are_dropped(spark, evaluate):
    bad = ["以下为新消息", "113条新消息", "跳转到最新消息", "查看更多消息", "对方正在输入…", "[你撤回了一条消息]"]
    assert evaluate(is_system_notice("x"), bad + ["新消息来了", "收到"]) == [True] * 6 + [False] * 2
    assert texts(dd.compose_messages(blocks(spark, [("a", 0, i, t) for i, t in enumerate(bad + ["正文"])]), ["chat"])) == ["正文"]


def test_fingerprint_ignores_unicode_white_space(evaluate):
    got = evaluate(text_fingerprint("x"), ["ab", "a　b", "a b\n", "abc"])
    assert got[0] == got[1] == got[2] != got[3]


def test_overlap_against_model(spark, monkeypatch):
    monkeypatch.setattr(dd, "SCREENS_PER_SLICE", 4)
    rng = random.Random(5)
    rows, want = [], []
    for chat in range(20):
        last = {}
        for screen in range(30):
            count = Counter()
            for cy in range(rng.randint(0, 5)):
                t = rng.choice("abcdef")
                key = (t, count[t])
                count[t] += 1
                rows.append((str(chat), screen, cy, t))
                if key not in last or screen - last[key] >= 3:
                    want.append((str(chat), screen, cy, t))
                last[key] = screen
    got = dd.compose_messages(blocks(spark, rows), ["chat"]).select("chat", "screen_idx", "cy", "text").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_stop_after_idle_against_model(spark):
    rng = random.Random(6)
    rows, want = [], []
    for chat in range(30):
        run, stopped = 0, False
        for s in range(60):
            added = int(rng.random() < 0.4)
            rows.append((chat, s, added))
            if not stopped:
                want.append((chat, s))
            run = 0 if added else run + 1
            stopped = stopped or run >= 4
    df = spark.createDataFrame(rows, "chat int, screen_idx int, added int")
    got = stop_after_idle(df, ["chat"], 4)
    assert sorted((r.chat, r.screen_idx) for r in got.collect()) == want


def test_stable_screens(spark):
    rows = [("a", i, d) for i, d in enumerate("xxxxyyyyyx")]
    df = spark.createDataFrame(rows, "chat string, screen_idx int, digest string")
    got = {r.screen_idx: r.stable for r in dd.stable_screens(df, ["chat"]).collect()}
    assert [got[i] for i in range(10)] == [False, False, False, True, False, False, False, True, True, False]


def test_carry_scan_against_model(spark):
    rng = random.Random(7)
    rows, want = [], []
    for k in range(8):
        last, total = None, 0
        for i in range(rng.randint(0, 50)):
            v = rng.choice([None, None, rng.randint(0, 9)])
            rows.append((k, i, v))
            last, total = (v if v is not None else last), total + (v or 0)
            want.append((k, i, last, total))
    df = spark.createDataFrame(rows, "k int, i int, v int")
    out = carry_scan(df, ["k"], slice_of("i", 4), [F.col("i")], last={"l": F.col("v")}, total={"t": F.col("v")})
    assert sorted(tuple(r) for r in out.select("k", "i", "l", "t").collect()) == want
    n = number_rows(df, ["k"], slice_of("i", 4), [F.col("i")], "n").collect()
    assert all(r.n == r.i + 1 for r in n)


def test_halo_copies_only_the_edge(spark):
    out = with_halo(spark.range(10).withColumnRenamed("id", "p"), "p", 5, 2).collect()
    assert sorted((r._slice, r.p) for r in out if r._ghost) == [(1, 3), (1, 4), (2, 8), (2, 9)]
    assert sum(not r._ghost for r in out) == 10


def test_windows_wider_than_a_slice(spark):
    df = spark.createDataFrame([("a", 500, "x", 0), ("a", 2500, "x", 0)], "chat string, screen_idx int, fp string, rank int")
    assert [r.screen_idx for r in dd.dedup_overlap(df, ["chat"], window=3000).collect()] == [500]


def test_null_keys_and_great_keys_keep_their_scan(spark):
    """Rows without a key are a key of their own; whole numbers beside them stay exact."""
    great = 2**60 + 1
    rows = [(k, i, float(i)) for k in (None, great, great + 1) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "chat long, seq long, x double")
    out = carry_scan(df, ["chat"], slice_of("seq", 2), [F.col("seq")], last={"seen": F.when(F.col("seq") == 1, F.col("x"))}, total={"sum": F.col("seq")})
    got = {(r.chat, r.seq): (r.seen, r.sum) for r in out.collect()}
    assert got == {(k, i): (1.0, i * (i + 1) // 2) for k in (None, great, great + 1) for i in range(1, 8)}
    lines = df.select("chat", "seq", F.lit("abcd").alias("line"))
    from chatloom.operators.mapreduce import number_chunks

    got = {(r.chat, r.seq): r.chunk_no for r in number_chunks(lines, ["chat"], 8, width=3).collect()}
    assert got == {(k, i): (i - 1) // 2 for k in (None, great, great + 1) for i in range(1, 8)}
