import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chatloom.operators import mapreduce as mr
from chatloom.operators import transcript as tr
from chatloom.operators.activity import activity_pauses, pause_counts


def model_chunks(lengths, limit):
    out, no, fill = [], 0, 0
    for n in lengths:
        out.append(no)
        fill += n
        if fill >= limit:
            no, fill = no + 1, 0
    return out


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_chunks_against_model(spark, width):
    rng = random.Random(width)
    rows, want = [], {}
    for chat in range(60):
        lengths = [rng.choice([0, 0, 1, 2, 5, 9, 10, 25]) for _ in range(rng.randint(1, 60))]
        for i, (n, no) in enumerate(zip(lengths, model_chunks(lengths, 10)), 1):
            rows.append((chat, i, "x" * n))
            want[chat, i] = no
    df = spark.createDataFrame(rows, "chat int, seq bigint, line string")
    got = {(r.chat, r.seq): r.chunk_no for r in mr.number_chunks(df, ["chat"], 10, width=width).collect()}
    assert got == want


def test_chunk_text(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(["甲乙", "丙", "丁戊", "己"], 1)], "chat string, seq bigint, line string")
    out = mr.chunk_lines(df, ["chat"], 3).orderBy("chunk_no").collect()
    assert [(r.text, r.n_lines, r.n_chars) for r in out] == [("甲乙\n丙", 2, 3), ("丁戊\n己", 2, 3)]
    assert mr.chunk_lines(df.limit(0), ["chat"]).count() == 0


def test_map_drops_replies_that_cannot_be_read(spark):
    chunks = spark.createDataFrame([("a", 0, "one"), ("a", 1, "two")], "chat string, chunk_no bigint, text string")
    fn = lambda t: "sorry" if t == "one" else '{"todos": [{"desc": "d", "owner": "o"}], "viewpoints": [{"who": "w", "point": "p"}]}'
    mapped = mr.map_chunks(chunks, ["chat"], fn)
    assert [r.raw for r in mapped.orderBy("chunk_no").collect()] == ["sorry", None]
    out = mr.points_of(mapped, ["chat"]).orderBy("category").collect()
    assert [(r.category, r.desc, r.owner, r.who, r.point) for r in out] == [("todos", "d", "o", None, None), ("viewpoints", None, None, "w", "p")]


def test_merge_points(spark):
    rows = [("r", "facts", 0, 0, "abc", None, None), ("r", "facts", 0, 1, "cab", None, None), ("r", "facts", 1, 0, "abd", None, None),
            ("r", "viewpoints", 0, 0, None, "甲", "好"), ("r", "viewpoints", 1, 0, None, "甲", "好")]
    df = spark.createDataFrame(rows, "report string, category string, chunk_no int, pos int, desc string, who string, point string")
    m = mr.merge_points(df, ["report"])
    assert sorted(r.desc or r.point for r in m.collect()) == ["abc", "abd", "好"]
    assert mr.merge_points(df, ["report"], exact=True).count() == 4
    assert {r.category: r.n for r in mr.reduce_points(df, ["report"]).collect()} == {"facts": 2, "viewpoints": 1}


def test_points_json_is_cut_exactly(spark):
    rows = [("r", c, 0, i, f"{c}{i}") for c in ("events", "facts") for i in range(50)]
    df = spark.createDataFrame(rows, "report string, category string, chunk_no int, pos int, desc string")
    whole = mr.points_json(df, ["report"], chars=100000).first().points
    assert [len(json.loads(whole)[c]) for c in ("events", "todos", "facts")] == [50, 0, 50]
    for n in (40, 333, 1200):
        assert mr.points_json(df, ["report"], chars=n).first().points == whole[:n]


MSG = "chat string, seq int, kind string, text string, ts timestamp_ntz, speaker string, side string, time_label string"


def chat(spark):
    rows = [("a", 1, "text", "三", datetime(2026, 8, 3, 9), "甲", "left", ""), ("a", 2, "text", "四", datetime(2026, 4, 24, 9), "86.6K", "left", ""),
            ("a", 3, "text", "二", datetime(2026, 2, 11, 9), "", "right", ""), ("a", 4, "text", "五", datetime(2026, 8, 5, 8, 30), "黄春健", "left", ""),
            ("a", 5, "text", "无", None, "581", "right", "昨天"), ("a", 6, "voice", '12"', None, "", "left", ""), ("a", 7, "text", "PDF", None, "甲", "left", ""),
            ("a", 8, "image", "", None, "甲", "left", ""), ("a", 9, "time", "系统", None, "", "left", "")]
    return spark.createDataFrame(rows, MSG)


def test_transcript(spark):
    out = [r.line for r in tr.transcript_lines(chat(spark), ["chat"]).orderBy("at", "seq", "part").collect()]
    assert out == ["■ 2026年02月11日", "【我】 二　09:00", "■ 2026年04月24日", "四　09:00", "■ 2026年08月03日", "【甲】 三　09:00", "■ 2026年08月05日",
                   "【黄春健】 五　08:30", "【我】 无", ' 〔语音 12"〕', "【甲】 [图片]", "系统"]


def test_leading_undated_rows_come_first(spark):
    rows = [("a", 1, None), ("a", 2, datetime(2026, 1, 2)), ("a", 3, datetime(2026, 1, 1)), ("a", 4, None)]
    df = spark.createDataFrame(rows, "chat string, seq int, ts timestamp_ntz")
    out = tr.reading_position(tr.chrono_order(df, ["chat"], width=2), ["chat"]).orderBy("pos").collect()
    assert [r.seq for r in out] == [1, 3, 4, 2]


def test_model_transcript(spark):
    m = chat(spark).withColumn("report", F.lit(1))
    out = [r.line for r in tr.build_transcript(m, ["report"]).orderBy("seq").collect()]
    assert out[0] == "[2026-08-03 09:00] 甲：三" and out[2] == "[2026-02-11 09:00] 我方：二" and out[4] == "[昨天] 581：无"
    assert out[5] == '[] [语音 12"]' and out[7] == "[] [图片] （图片）" and len(out) == 8
    two = m.unionByName(m.withColumn("chat", F.lit("b")))
    heads = [r.line for r in tr.build_transcript(two, ["report"]).filter("part = 0").orderBy("chat").collect()]
    assert heads == ["===== 聊天来源：a =====", "===== 聊天来源：b ====="]


def test_pauses(spark):
    t0 = datetime(2026, 1, 1)
    from datetime import timedelta
    ev = spark.createDataFrame([("u", t0 + timedelta(seconds=s)) for s in (100, 110, 140, 300)] + [("w", t0)], "user string, ts timestamp_ntz")
    p = activity_pauses(ev, ["user"], 30, span=50)
    got = [(r.pause_start, r.resume_at, r.n_events) for r in p.filter("user = 'u'").orderBy("pause_no").collect()]
    assert got == [(t0 + timedelta(seconds=100), t0 + timedelta(seconds=170), 3), (t0 + timedelta(seconds=300), t0 + timedelta(seconds=330), 1)]
    c = {r.user: (r.n_pauses, r.n_resumes) for r in pause_counts(p, ["user"]).collect()}
    assert c == {"u": (2, 3), "w": (1, 2)}


def test_captions_cover_the_first_images_only(spark):
    m = spark.createDataFrame([("a", i, "image", "", f"p{i}") for i in range(4)] + [("a", 9, "text", "t", "p0")],
                              "chat string, seq int, kind string, text string, img_path string")
    caps = spark.createDataFrame([("p0", "零"), ("p2", "二"), ("p3", "三")], "img_path string, caption string")
    out = tr.apply_captions(m, caps, 3).orderBy("seq").collect()
    assert [r.text for r in out] == ["零", "", "二", "", "t"]


def test_two_captions_of_an_image_make_one_message(spark):
    m = spark.createDataFrame([("a", 1, "image", "", "p"), ("a", 2, "text", "t", None)], "chat string, seq int, kind string, text string, img_path string")
    caps = spark.createDataFrame([("p", "b"), ("p", "a")], "img_path string, caption string")
    assert [r.text for r in tr.apply_captions(m, caps, 3).orderBy("seq").collect()] == ["a", "t"]


def test_a_chat_without_lines_is_still_named(spark):
    m = chat(spark).withColumn("report", F.lit(1))
    silent = spark.createDataFrame([("b", 1, "time", "", None, "", "left", "")], MSG).withColumn("report", F.lit(1))
    heads = [r.line for r in tr.build_transcript(m.unionByName(silent), ["report"]).filter("part = 0").orderBy("chat").collect()]
    assert heads == ["===== 聊天来源：a =====", "===== 聊天来源：b ====="]


def test_the_model_is_asked_once_a_chunk(spark, tmp_path):
    folder = str(tmp_path)

    def ask(text):
        import uuid
        from pathlib import Path

        Path(folder, uuid.uuid4().hex).write_text(text)
        return mr.extract_by_rules(text)

    chunks = spark.createDataFrame([(1, i, f"2026-01-0{i + 1} a\nwhy?\n3 items") for i in range(8)], "report int, chunk_no int, text string")
    points = mr.points_of(mr.map_chunks(chunks, ["report"], ask), ["report"]).collect()
    assert len(points) == 24 and len(list(tmp_path.iterdir())) == 8


def test_points_that_agree_in_eighty_characters_stay_apart(spark):
    text = "".join(chr(0x4E00 + i) for i in range(80))
    df = spark.createDataFrame([(1, "facts", 0, 0, text + "龍"), (1, "facts", 0, 1, text + "龜")], "report int, category string, chunk_no int, pos int, desc string")
    assert mr.merge_points(df, ["report"]).count() == 2 and mr.merge_points(df, ["report"], key_chars=80).count() == 1


def test_pages_of_points_lose_nothing(spark):
    r = random.Random(3)
    rows = [("r", c, i // 7, i % 7, f"{c}{i}" + '"\\x' * r.randint(0, 40)) for c in ("events", "facts", "todos") for i in range(60)]
    df = spark.createDataFrame(rows, "report string, category string, chunk_no int, pos int, desc string")
    for chars in (300, 900, 100_000):
        pages = [x.points for x in mr.points_pages(df, ["report"], chars=chars).orderBy("page").collect()]
        assert all(len(p) <= chars or sum(map(len, json.loads(p).values())) == 1 for p in pages)
        got = [(c, e["desc"]) for p in pages for c, es in json.loads(p).items() for e in es]
        want = [(c, x[4]) for c in ("events", "todos", "facts") for x in rows if x[1] == c]
        assert sorted(got) == sorted(want)
        for c in ("events", "todos", "facts"):
            assert [d for k, d in got if k == c] == [d for k, d in want if k == c]


def test_documents_hold_every_point_and_chat_name(spark):
    rows = [("r", c, i, 0, f"{c} number {i} of many") for c in ("events", "facts") for i in range(120)]
    df = spark.createDataFrame(rows, "report string, category string, chunk_no int, pos int, desc string")
    chats = spark.createDataFrame([("r", f"chat {i:03d}") for i in range(150)] + [("empty", "alone")], "report string, chat string")
    brief = spark.createDataFrame([("r", "in short"), ("empty", "nothing")], "report string, brief string")
    docs = mr.reduce_input(chats, brief, mr.points_pages(df, ["report"], chars=2000), ["report"]).orderBy("page").collect()
    whole = [x.document for x in docs if x.report == "r"]
    assert [x.page for x in docs if x.report == "r"] == list(range(len(whole))) and len(whole) > 1
    assert [(x.page, "JSON" in x.document) for x in docs if x.report == "empty"] == [(0, False)]
    assert all(f"chat {i:03d}" in x for x in whole for i in range(150))
    pages = [json.loads(x.split("（JSON）：\n")[1]) for x in whole]
    assert sorted(e["desc"] for p in pages for es in p.values() for e in es) == sorted(x[4] for x in rows)
    cut = mr.reduce_input(chats, brief, mr.points_json(df, ["report"], chars=2000), ["report"], parity=True).filter("report = 'r'").collect()
    assert len(cut) == 1 and len(cut[0].document.split("（JSON）：\n")[1]) == 2000 and "chat 149" not in cut[0].document


def test_no_category_of_a_report_is_one_slice(spark):
    rows = [("r", "facts", i, 0, f"fact {i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "report string, category string, chunk_no int, pos int, desc string")
    seen, scan = [], mr.carry_scan

    def spy(d, keys, piece, *more, **k):
        seen.append(d.groupBy(*keys, piece.alias("piece")).count().agg({"count": "max"}).first()[0])
        return scan(d, keys, piece, *more, **k)

    mr.carry_scan = spy
    try:
        pages = [x.points for x in mr.points_pages(df, ["report"], chars=3000).orderBy("page").collect()]
    finally:
        mr.carry_scan = scan
    assert seen[0] <= 1024
    assert [e["desc"] for p in pages for e in json.loads(p)["facts"]] == [x[4] for x in rows]


def test_frames_are_handed_to_the_model_one_after_the_other(spark):
    def model(frames):
        loaded = []         # what a task sets up once
        for f in frames:
            loaded.append(len(f))
            yield [f"{t} {len(loaded)}" for t in f["text"]]

    chunks = spark.createDataFrame([("a", i, f"t{i}") for i in range(25)], "chat string, chunk_no int, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
        got = {r.chunk_no: r.reply for r in mr.map_chunks(chunks, ["chat"], frames=model).select("chunk_no", "reply").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {i: f"t{i} {i // 10 + 1}" for i in range(25)}
    with pytest.raises(Exception, match="replies"):
        mr.map_chunks(chunks, ["chat"], frames=lambda fs: ([] for _ in fs)).collect()


@pytest.mark.parametrize("commits", [1, 3])
def test_a_rerun_asks_only_what_is_not_answered(spark, tmp_path, commits):
    calls, store = str(tmp_path / "calls"), str(tmp_path / "store")

    def ask(text):
        import os
        import uuid

        os.makedirs(calls, exist_ok=True)
        open(f"{calls}/{uuid.uuid4().hex}", "w").close()
        return mr.extract_by_rules(text)

    def run(texts, version=""):
        import os

        before = len(os.listdir(calls)) if os.path.isdir(calls) else 0
        chunks = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "chat string, chunk_no int, text string")
        out = mr.map_chunks(chunks, ["chat"], ask, store=store, version=version, commits=commits)
        assert sorted((r.chunk_no, r.reply) for r in out.collect()) == [(i, mr.extract_by_rules(t or "")) for i, t in enumerate(texts)]
        return len(os.listdir(calls)) - before

    texts = [f"2026-01-0{i + 1} a\nwhy?\n3 items" for i in range(8)]
    assert run(texts) == 8
    assert run(texts) == 0
    assert run([*texts[:7], "4 more", texts[0], ""]) == 2
    assert run(texts, "another prompt") == 8
