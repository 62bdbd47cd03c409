import json

from pyspark.sql import functions as F

from chatloom.functions import text as tx
from chatloom.functions.lines import parse_json_loose, resolved_title
from chatloom.functions.vectors import vector_dhash, vectors_equal, vectors_relate


def test_ui_noise(evaluate):
    bad = ["86.6K", "3M", "12.5k", ":38", "7:38", "14:05", "and", "Bne", "PDF", " PDF "]
    good = ["收到", "12", "ok", "OK", "明早7:30出发", "", "good", "Okay", "hello"]
    assert evaluate(tx.is_ui_noise("x"), bad + good) == [True] * len(bad) + [False] * len(good)


def test_bad_speaker(evaluate):
    assert evaluate(tx.is_bad_speaker("x"), ["86.6K", "581", "and", ":38", "1 2.5", "", "刘浩总包部安全", "  "]) == [True] * 5 + [False] * 3


def test_meaningful(evaluate):
    good = ["视频接入测试", "2026-09-01", "chat", " 中a ", "12:30:4", "12-34"]
    bad = ["PDF", "中", "12", "", "a b c d", "1-3"]
    assert evaluate(tx.is_meaningful("x"), good + bad) == [True] * len(good) + [False] * len(bad)


def test_fused_suffix(spark):
    cases = {"黄藏寺项目值班值守20:57": ("黄藏寺项目值班值守", ""), "新疆兵团设计院昨天14:12": ("新疆兵团设计院", ""),
             "钧棋13674969...2024/10": ("钧棋13674969", "2024/10"), "大有咨询王博 2024/9": ("大有咨询王博", "2024/9"),
             "HZS对下支付管理专...08/29": ("HZS对下支付管理专", "08/29"), "3-2班": ("3-2班", ""), "136749694202": ("136749694202", ""),
             "项目2024": ("项目", "2024"), "08/29": ("08/29", "")}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r.x: (r.c["name"], r.c["stamp"]) for r in df.select("x", tx.strip_fused_suffix("x").alias("c")).collect()}
    assert got == cases


def test_safe_name(evaluate):
    assert evaluate(tx.safe_name("x"), ["a/b:c", "__", "项目群 1", "x" * 70]) == ["a_b_c", "chat", "项目群_1", "x" * 60]


def test_character_key_handles_emoji(evaluate):
    assert evaluate(tx.character_key("x"), ["cab", "abc", "😀a😀", ""]) == ["abc", "abc", "a😀", ""]


def test_json_loose(spark):
    texts = ['{"a": 1}', '```json\n{"a": 2}\n```', 'Sure: {"a": 3} ok', "```\n{\"a\": 4}```", "not json", "", "{broken"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").withColumn("j", parse_json_loose("x"))
    out = df.select("i", F.to_json("j.value").alias("v"), "j.raw").orderBy("i").collect()
    assert [json.loads(r.v)["a"] if r.v else None for r in out] == [1, 2, 3, 4, None, None, None]
    assert [r.raw for r in out] == [None] * 4 + ["not json", "", "{broken"]


def test_titles(evaluate):
    t = lambda title, template: resolved_title(F.lit(title), F.col("x"), F.lit(template))
    assert evaluate(t("", "work"), ["甲、乙", "", "长" * 31]) == ["甲、乙工作情况报告", "聊天记录工作情况报告", "长" * 30 + "…工作情况报告"]
    assert evaluate(t("标题", "work"), ["甲"]) == ["标题"]
    assert evaluate(t("", "other"), ["甲"]) == ["甲分析报告"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 0.0], [1.0, 3.0, 2.0, 0.0], [5.0] * 4, [2.0, 4.0, 4.0, 0.0])],
                               "a array<float>, b array<float>, c array<float>, d array<float>")
    r = df.select(vector_dhash("a").alias("h"), vector_dhash("a", 2).alias("g"), vectors_equal("a", "b").alias("e"),
                  vectors_equal("a", "c").alias("n"), vectors_relate("a", "d").alias("same"), vectors_relate("a", "c").alias("flat")).first()
    assert (r.h, r.g, r.e, r.n, r.flat) == ("i|100", "i|10", True, False, 0.0) and abs(r.same - 1) < 1e-9


def test_call_errors(evaluate):
    assert evaluate(tx.classify_call_error("x"), ["HTTP 429", "触发限流", "timeout"]) == ["rate_limit", "rate_limit", "other"]


def test_titles_of_any_length(spark):
    from chatloom.operators.transcript import report_titles
    chats = spark.createDataFrame([(1, f"chat {i:02d}") for i in range(40)], "report int, chat string")
    for chars in (5, 30, 100, None):
        whole = "、".join(f"chat {i:02d}" for i in range(40))
        got = report_titles(chats, ["report"], F.lit(""), F.lit("work"), chars).first().title
        assert got == (whole if chars is None else whole[:chars] + "…") + "工作情况报告"
