"""Report content from replies of any shape, and the lines ahead of a transcript."""

import json
from datetime import datetime

from chatloom.operators import report as rp
from chatloom.sources import sinks as sk

WHOLE = {"title": "T", "summary": "S", "sections": [{"heading": "h1", "paras": ["a", "b"]}, {"heading": "h2", "paras": "alone"}, {"heading": "h3"}, "loose", {"paras": [1, {"x": 2}]}],
         "conclusions": ["c1", 2, {"why": "x"}], "suggestions": "one"}
REPLIES = [
    ("whole", json.dumps(WHOLE)), ("fenced", "```json\n" + json.dumps(WHOLE) + "\n```"), ("prose", "Sure: " + json.dumps(WHOLE) + " - bye"),
    ("bare", json.dumps({"title": None, "summary": "S", "sections": None, "conclusions": [], "extra": 1})), ("empty", ""), ("null", None), ("words", "I can not" * 100),
    ("list", "[1, 2]")]


def content(spark, **options):
    r = spark.createDataFrame(REPLIES, "report string, reply string")
    points = spark.createDataFrame([("bare", '{"facts": []}'), ("words", "p" * 5000)], "report string, points string")
    return rp.report_content(r, ["report"], points, **options)


def test_replies_of_any_shape(spark):
    got = {r.report: r for r in content(spark).collect()}
    assert len(got) == len(REPLIES)
    sections = [("h1", ["a", "b"]), ("h2", ["alone"]), ("h3", []), ("", ["loose"]), ("", ["1", '{"x":2}'])]
    for name in ("whole", "fenced", "prose"):
        r = got[name]
        assert (r.title, r.summary, r.conclusions, r.suggestions) == ("T", "S", ["c1", "2", '{"why":"x"}'], ["one"])
        assert [(s.heading, s.paras) for s in r.sections] == sections
    only = lambda text: [("一、聊天记录要点", [text])]
    want = {"bare": ("S", '{"facts": []}'), "empty": ("", "{}"), "null": ("", "{}"), "words": ("I can not" * 100, "p" * 5000)}
    for name, (summary, text) in want.items():
        r = got[name]
        assert (r.title, r.summary, r.conclusions, r.suggestions) == ("", summary, [], []) and [(s.heading, s.paras) for s in r.sections] == only(text)
    cut = {r.report: r for r in content(spark, raw_chars=600, point_chars=3000).collect()}["words"]
    assert len(cut.summary) == 600 and len(cut.sections[0].paras[0]) == 3000


def test_rows_of_sections_and_conclusions(spark):
    c = content(spark).filter("report = 'whole'")
    rows = rp.section_rows(c, ["report"]).orderBy("no", "para_no").collect()
    assert [(r.no, r.heading, r.para_no, r.para) for r in rows] == [
        (1, "h1", 1, "a"), (1, "h1", 2, "b"), (2, "h2", 1, "alone"), (3, "h3", None, None), (4, "", 1, "loose"), (5, "", 1, "1"), (5, "", 2, '{"x":2}')]
    ends = rp.conclusion_rows(c, ["report"]).collect()
    assert [(r.part, r.no, r.text) for r in ends] == [("conclusion", 1, "c1"), ("conclusion", 2, "2"), ("conclusion", 3, '{"why":"x"}'), ("suggestion", 1, "one")]


def test_timeline_replies(spark):
    r = spark.createDataFrame([(1, '{"items": [{"date": "2026-02-01", "desc": "b"}, {"date": "2026-01-05", "desc": "a"}, {"desc": "undated"}]}'), (2, "none"), (3, None)], "report int, reply string")
    got = rp.timeline_points(r, ["report"]).orderBy("pos").collect()
    assert [(x.report, x.date, x.desc) for x in got] == [(1, "2026-02-01", "b"), (1, "2026-01-05", "a"), (1, "", "undated")]


def test_seven_tables(spark, tmp_path):
    m = spark.createDataFrame([("r", "a", 1, "text", "第一条消息很重要", datetime(2026, 1, 1, 9), "甲", "left"), ("r", "a", 2, "image", "", None, "", "right")],
                              "report string, chat string, seq int, kind string, text string, ts timestamp_ntz, speaker string, side string")
    replies = spark.createDataFrame([("r", json.dumps(WHOLE))], "report string, reply string")
    times = spark.createDataFrame([("r", '{"items": [{"date": "2026-01-01", "desc": "x"}]}')], "report string, reply string")
    captions = spark.createDataFrame([("r", 7, "b.png", "two"), ("r", 3, "a.png", "one")], "report string, image_no int, img_path string, caption string")
    tables = rp.report_tables(m, replies, ["report"], timeline_replies=times, captions=captions)
    sk.write_report_tables(tables, str(tmp_path / "r"))
    back = {k: spark.read.parquet(str(tmp_path / "r" / k)).collect() for k in tables}
    assert sorted(back) == ["conclusions", "images", "keywords", "overview", "sections", "speakers", "timeline"]
    assert [r.caption for r in sorted(back["images"], key=lambda r: r.no)] == ["图 1　one", "图 2　two"]
    assert [(r.no, r.month_heading) for r in back["timeline"]] == [(1, "2026 年 01 月")] and len(back["sections"]) == 7 and len(back["overview"]) == 6


def test_transcripts_with_heads(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, "text", "早", datetime(2026, 1, 1, 9), "甲", "left"), ("b", 1, "voice", "5", None, "", "right")],
                              "chat string, seq int, kind string, text string, ts timestamp_ntz, speaker string, side string")
    stored = spark.createDataFrame([("b", "2025-01-01 ~ 2025-02-01"), ("a", "")], "chat string, coverage string")
    heads = rp.head_lines(m, datetime(2026, 8, 27, 20, 5), "7d", stored)
    sk.write_transcript(m, str(tmp_path / "t"), heads=heads, files=1)
    texts = {p.name.split("=")[1][0]: next(p.glob("part-*")).read_text().splitlines() for p in (tmp_path / "t").glob("chat=*")}
    note = "（视觉自动化截图 + OCR 提取，严格只读；语音仅记录时长）"
    assert texts["a"] == ["a · 聊天记录", "导出时间：2026-08-27 20:05　·　时间窗：7d（实际覆盖 2026-01-01 ~ 2026-01-01）　·　文字 1 条 / 图片 0 张 / 语音 0 条", note,
                          "■ 2026年01月01日", "【甲】 早　09:00"]
    assert texts["b"][1].endswith("（实际覆盖 2025-01-01 ~ 2025-02-01）　·　文字 0 条 / 图片 0 张 / 语音 1 条") and len(texts["b"]) == 4
