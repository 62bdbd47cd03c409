import random
from datetime import date, datetime

import pytest

from chatloom.functions.stamps import is_stamp, norm_stamp_digits, stamp_older_than, window_cutoff
from chatloom.operators import layout as lo
from chatloom.operators import selection as se
from chatloom.operators.filters import layout_denoise, skip_system_chats, tiered_threshold

AS_OF = datetime(2026, 9, 4, 12)


@pytest.mark.parametrize("cutoff,want", [
    (date(2025, 9, 4), {True: ["2024/07/23", "2024/10", "2024", "2024-06-30", "2U24/U9/2U", "2O24/1O/05", "2024/13/99"],
                        False: ["2026/09/01", "2025/10/03", "昨天", "星期三", "21:36", "8-29", "12/17"], None: ["", "U4/U/ 1", "2025", "86/45", "13/01", "2/30"]}),
    (date(2026, 1, 1), {True: ["12/17", "2025"], False: ["04/07", "2027"], None: ["2026"]})])
def test_stamp_older_than(evaluate, cutoff, want):
    for value, stamps in want.items():
        got = evaluate(stamp_older_than("x", cutoff, AS_OF.date()), stamps)
        # O is not a zero everywhere: 2O24 stays readable after repair
        assert got == [value] * len(stamps), dict(zip(stamps, got))


def test_stamp_shapes(evaluate):
    assert evaluate(is_stamp("x"), ["21:36", "昨天", "星期三", "[56条]", "2024/07/23", "8-29", "2U24/U9/2U", "3条新消息", "黄春健", "2024"]) == [True] * 8 + [False] * 2
    assert evaluate(norm_stamp_digits("x"), ["2U24/U9/2U", "l2:I5", "1 2:30"]) == ["2024/09/20", "12:15", "12:30"]


def test_cutoff():
    assert window_cutoff("2026", AS_OF) == date(2026, 1, 1)
    assert window_cutoff("365d", AS_OF) == date(2025, 9, 5)
    assert window_cutoff("", AS_OF) is None


def frame(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "frame_id int, seq int, text string, cx int, cy int, score double")


def test_list_items(spark):
    b = frame(spark, [("搜索", 60, 5, .9), ("【畅聊1群】", 60, 47, .9), ("21:36", 220, 47, .9), ("张三：你好", 70, 67, .9), ("[3条]", 200, 67, .9),
                      ("黄春健", 60, 112, .9), ("2U24/U9/2U", 220, 113, .33), ("明天见", 60, 132, .9), ("值守昨天14:12", 60, 177, .9), ("·", 60, 300, .9)])
    out = lo.list_items(b, ["frame_id"], 248).orderBy("item").collect()
    assert [(r.name, r.stamp, r.row_y) for r in out] == [("【畅聊1群】", "21:36", 47), ("黄春健", "2U24/U9/2U", 112), ("值守", "", 177)]


def test_denoise_right_column(spark):
    b = frame(spark, [("12", 60, 50, .9), ("12", 220, 50, .9), ("8-29", 60, 50, .9), ("以搜索", 60, 50, .9), ("名字", 60, 10, .9)])
    assert [(r.text, r.cx) for r in layout_denoise(b, 248).collect()] == [("12", 60)]


def test_two_floors_one_scan(spark):
    b = frame(spark, [("a", 0, 0, .2), ("b", 0, 0, .3), ("c", 0, 0, .5)])
    t = tiered_threshold(b)
    assert {r.text: r.for_name for r in t.collect()} == {"b": False, "c": True}


def test_speaker(spark):
    b = spark.createDataFrame([(1, 1, "李琦", 50, 45, 20, 40, 80, 60), (1, 2, "设备已上线", 80, 85, 20, 72, 150, 98), (1, 3, "收到", 400, 85, 380, 72, 420, 98)],
                              "screen int, seq int, text string, cx int, cy int, x0 int, y0 int, x1 int, y1 int")
    got = {r.text: (r.speaker, r.side, r.is_nickname) for r in lo.attribute_speaker(b, ["screen"], 500).collect()}
    assert got == {"李琦": ("", "left", True), "设备已上线": ("李琦", "left", False), "收到": ("", "right", False)}


def test_merge_boxes_against_model(spark):
    rng = random.Random(3)
    rows = sorted({(s, rng.randint(0, 60), rng.randint(0, 60), rng.randint(5, 40), rng.randint(5, 40)) for s in range(15) for _ in range(12)})

    def model(boxes):
        kept = []
        for x, y, w, h in sorted(boxes, key=lambda b: (b[1], b[0], b[2], b[3])):
            for i, (a, b, c, d) in enumerate(kept):
                iw, ih = min(a + c, x + w) - max(a, x), min(b + d, y + h) - max(b, y)
                inter = max(iw, 0) * max(ih, 0) if iw > 0 and ih > 0 else 0
                iou = inter / max(1, c * d + w * h - inter)
                if iou > .3 or inter == min(c * d, w * h) and inter:
                    nx, ny = min(a, x), min(b, y)
                    kept[i] = (nx, ny, max(a + c, x + w) - nx, max(b + d, y + h) - ny)
                    break
            else:
                kept.append((x, y, w, h))
        return kept

    df = spark.createDataFrame(rows, "screen int, x int, y int, w int, h int")
    out = lo.merge_boxes(df, ["screen"]).orderBy("screen", "box_no").collect()
    for s in range(15):
        assert [(r.x, r.y, r.w, r.h) for r in out if r.screen == s] == model([r[1:] for r in rows if r[0] == s])


def test_selection(spark):
    names = ["A活跃", "B无戳", "C旧置顶", "D去年12月", "E无戳老", "F更老无戳"]
    stamps = {"A活跃": "昨天", "C旧置顶": "2024/07/23", "D去年12月": "12/17"}
    n = spark.createDataFrame([("l", i, x) for i, x in enumerate(names)], "list_id string, pos int, name string")
    s = spark.createDataFrame([("l", i, k, v) for i, (k, v) in enumerate(stamps.items())], "list_id string, pos int, name string, stamp string")
    out = se.select_active(n, s, "365d", AS_OF, ["list_id"], variants=False)
    assert [r.name for r in out.orderBy("pos").collect()] == ["A活跃", "B无戳", "D去年12月"]
    old = s.filter("stamp = '2024/07/23'")
    assert se.select_active(n, old, "365d", AS_OF, ["list_id"], variants=False).count() == 5
    assert se.select_active(n, s, "", AS_OF, ["list_id"]).count() == 6


def test_skip_reason_order(spark):
    n = spark.createDataFrame([("微信团队", "done", None), ("别的", None, None), ("要的done", "done", "2020/01"), ("要的err", "error", None),
                               ("要的old", None, "2020/01"), ("要的new", None, "昨天"), ("要的?", None, None)], "name string, status string, stamp string")
    out = se.skip_reason(n, date(2026, 1, 1), AS_OF.date(), only=["要的"])
    assert [r.reason for r in out.collect()] == ["system", "not-only", "done", "error", "old", None, None]


def test_deny_list(spark):
    n = spark.createDataFrame([("微信团队",), ("群聊",), ("群聊2",)], "name string")
    assert [r.name for r in skip_system_chats(n).collect()] == ["群聊2"]


def test_progress_and_summary(spark):
    rows = [("r", i, "error" if i % 4 == 0 else "done", 10, datetime(2026, 1, 1, 0, i)) for i in range(1, 14)]
    led = spark.createDataFrame(rows, "run string, seq int, status string, messages int, at timestamp_ntz")
    out = se.progress_every_n(led, ["run"], 5).orderBy("seq").collect()
    assert [(r.done, r.failed, r.messages, r.mean_seconds) for r in out] == [(5, 1, 50, 60), (10, 3, 100, 72)]
    skipped = spark.createDataFrame([("r",), ("r",)], "run string")
    s = se.batch_summary(led, skipped, ["run"]).first()
    assert (s.done, s.failed, s.skipped, s.messages) == (10, 3, 2, 100)
    assert se.batch_summary(led, skipped).first().skipped == 2
