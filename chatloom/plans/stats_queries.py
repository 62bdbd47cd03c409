"""Statistics, filters on messages and report tables."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.text import classify_call_error
from ..operators import filters as fl
from ..operators import stats as st
from ..operators.mapreduce import timeline
from ..operators.transcript import apply_captions, image_budget, report_titles
from . import views as v
from .registry import query

MSG = lambda body: v.with_views(body, "msg")
WHO = "coalesce(nullif(speaker, ''), CASE WHEN side = 'right' THEN '我方' ELSE '其他' END)"
NOISE = r"regexp_matches(trim(text), '^(?:\d+(?:\.\d+)?[KMGkmg]|[QO\d]{0,2}[:：]\d{1,2}|[A-Za-z]{1,3})$') " \
        "AND lower(trim(text)) NOT IN ('ok','okay','no','yes','hi','hello','good','fine')"


@query(MSG("""SELECT 1 AS no, '消息总量' AS metric, count(*) || ' 条' AS value FROM msg
UNION ALL SELECT 2, '文字消息', count(*) FILTER (kind = 'text') || ' 条' FROM msg
UNION ALL SELECT 3, '图片消息', count(*) FILTER (kind = 'image') || ' 条' FROM msg
UNION ALL SELECT 4, '语音消息', count(*) FILTER (kind = 'voice') || ' 条' FROM msg
UNION ALL SELECT 5, '活跃天数', count(DISTINCT ts::DATE) || ' 天' FROM msg
UNION ALL SELECT 6, '消息峰值日', (SELECT d::VARCHAR || '（' || n || ' 条）' FROM (
    SELECT ts::DATE AS d, count(*) AS n FROM msg WHERE ts IS NOT NULL GROUP BY 1 ORDER BY n DESC, d LIMIT 1))"""))
def report_overview(spark, d):
    return st.report_overview(v.msg_events(spark, d))


@query(MSG("""SELECT kind AS view, event_id, chat, text FROM msg WHERE kind IN ('text', 'image', 'voice')"""))
def kind_views(spark, d):
    m = v.msg_events(spark, d)
    parts = [p.select(F.lit(n).alias("view"), "event_id", "chat", "text")
             for n, p in (("text", fl.texts(m)), ("image", fl.images(m)), ("voice", fl.voices(m)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(MSG("""SELECT event_id, chat, ts FROM msg
WHERE ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""))
def filter_time_window(spark, d):
    out = fl.filter_time_window(v.msg_events(spark, d), "7d", datetime(2024, 1, 20, 12))
    return out.select("event_id", "chat", "ts")


@query(MSG("""SELECT event_id, text FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '以下为新消息' WHEN 1 THEN event_id || '条新消息'
  WHEN 2 THEN '对方正在输入…' WHEN 3 THEN '[你撤回了一条消息]' WHEN 4 THEN '开会时间是14:30分' ELSE text END AS text FROM msg)
WHERE NOT regexp_matches(text, '^(以下为新消息|\\[.*撤回.*\\]|\\d+条新消息|对方正在输入.*)$')""".replace("\\\\", "\\")))
def drop_system_noise(spark, d):
    i = F.col("event_id") % 9
    t = (F.when(i == 0, "以下为新消息").when(i == 1, F.concat(F.col("event_id").cast("string"), F.lit("条新消息")))
         .when(i == 2, "对方正在输入…").when(i == 3, "[你撤回了一条消息]").when(i == 4, "开会时间是14:30分").otherwise(F.col("text")))
    return fl.drop_system_noise(v.msg_events(spark, d).select("event_id", t.alias("text")))


@query(v.with_views(f"SELECT chat, count(*) AS n, count(*) FILTER (NOT ({NOISE})) AS kept FROM tokens GROUP BY 1", "tokens"))
def drop_ui_noise(spark, d):
    t = v.doc_tokens(spark, d)
    kept = fl.drop_ui_noise(t).groupBy("chat").agg(F.count("*").alias("kept"))
    return (t.groupBy("chat").agg(F.count("*").alias("n")).join(kept, "chat", "left")
            .withColumn("kept", F.coalesce("kept", F.lit(0))))


@query(MSG(r"""SELECT event_id, CASE WHEN bad THEN NULL ELSE s END AS speaker,
  CASE WHEN NOT bad AND s <> '' THEN s WHEN side = 'right' THEN '我' END AS shown
FROM (SELECT *, s IN ('86.6K', 'and') OR regexp_matches(s, '^[\d\s.]+$') AS bad FROM (
  SELECT event_id, side, CASE event_id % 6 WHEN 0 THEN '86.6K' WHEN 1 THEN '581' WHEN 2 THEN 'and' WHEN 3 THEN '1 2.5' ELSE speaker END AS s FROM msg))"""))
def clean_speaker(spark, d):
    i = F.col("event_id") % 6
    s = F.when(i == 0, "86.6K").when(i == 1, "581").when(i == 2, "and").when(i == 3, "1 2.5").otherwise(F.col("speaker"))
    return fl.clean_speaker(v.msg_events(spark, d).withColumn("speaker", s)).select("event_id", "speaker", "shown")


MEANING = r"""length(t) >= 2 AND (regexp_matches(t, '[一-鿿]') OR (length(t) >= 6 AND regexp_matches(t, '^[\d.\-:/]+$'))
  OR (length(t) >= 4 AND regexp_matches(t, '^[A-Za-z0-9.\-:_/]+$')))"""


@query(v.with_views(f"""SELECT chat, text, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY pos) AS rank FROM (
  SELECT chat, t AS text, min(pos) AS pos FROM (SELECT chat, trim(text, ' \t') AS t, pos FROM tokens) WHERE {MEANING} GROUP BY 1, 2))
WHERE rank <= 10""", "tokens"))
def meaningful_lines(spark, d):
    return fl.meaningful_lines(v.doc_tokens(spark, d).select("chat", "text", "pos"), ["chat"], "pos")


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT IN ('small ring', 'red widget', '群聊')")
def skip_system_chats(spark, d):
    p = v.table(spark, d, "part").select("p_partkey", "p_name")
    return fl.skip_system_chats(p, ("small ring", "red widget", "群聊"), "p_name")


@query(MSG("SELECT kind, count(*) AS n FROM msg GROUP BY 1"))
def count_by_kind(spark, d):
    return st.count_by_kind(v.msg_events(spark, d))


@query(MSG("""SELECT c_custkey AS chat, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT chat, count(*) AS n FROM msg GROUP BY 1)
ON chat = c_custkey"""))
def count_by_chat(spark, d):
    chats = v.table(spark, d, "customer").select(F.col("c_custkey").alias("chat"))
    return st.count_by_chat(chats, v.msg_events(spark, d))


@query(MSG("SELECT report, min(ts) AS time_start, max(ts) AS time_end FROM msg GROUP BY 1"))
def time_span(spark, d):
    return st.time_span(v.msg_events(spark, d), ["report"])


@query(MSG(f"""SELECT report, who, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY n DESC, who) AS rank FROM (
  SELECT report, {WHO} AS who, count(*) AS n FROM msg WHERE kind IN ('text', 'voice', 'image') GROUP BY 1, 2)) WHERE rank <= 5"""))
def top_speakers(spark, d):
    return st.top_speakers(v.msg_events(spark, d), 5, ["report"])


@query(MSG("SELECT ts::DATE AS day, count(*) AS n FROM msg WHERE ts IS NOT NULL GROUP BY 1"))
def by_day(spark, d):
    return st.by_day(v.msg_events(spark, d))


@query(MSG("SELECT chat, count(DISTINCT ts::DATE) AS active_days FROM msg WHERE ts IS NOT NULL GROUP BY 1"))
def active_days(spark, d):
    return st.active_days(v.msg_events(spark, d), ["chat"])


@query(MSG("""SELECT chat, day, n FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY n DESC, day) AS r FROM (
  SELECT chat, ts::DATE AS day, count(*) AS n FROM msg WHERE ts IS NOT NULL GROUP BY 1, 2)) WHERE r = 1"""))
def peak_day(spark, d):
    return st.peak_day(v.msg_events(spark, d), ["chat"])


@query(MSG("SELECT hour(ts)::INT AS hour, count(*) AS n FROM msg WHERE ts IS NOT NULL GROUP BY 1"))
def by_hour(spark, d):
    return st.by_hour(v.msg_events(spark, d))


TERMS = """terms AS (
  SELECT report, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{2,}'))) AS term FROM src
  UNION ALL SELECT report, substr(run, i::INT, 2) FROM (
    SELECT report, run, unnest(range(1, length(run))) AS i FROM (
      SELECT report, unnest(regexp_extract_all(text, '[一-鿿]{2,}')) AS run FROM src))
  WHERE NOT regexp_matches(substr(run, i::INT, 2), '[的了是在我你他她它好很也都和与及或有没不这那就还要会请嗯哦哈呵啊吧吗呢啦呀上下里中到去来说看做用对从被把]'))"""
SRC = "src AS (SELECT report, text FROM msg WHERE kind = 'text')"


@query(MSG(f"""SELECT report, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY n DESC, term) AS rank FROM (
  SELECT report, term, count(*) AS n FROM terms GROUP BY 1, 2 HAVING count(*) >= 3)) WHERE rank <= 15""").replace(
    "\nSELECT report", f",\n{SRC}, {TERMS}\nSELECT report", 1))
def keywords(spark, d):
    return st.keywords(v.msg_events(spark, d), by=["report"])


@query("""WITH src AS (SELECT 0 AS report, text FROM documents), """ + TERMS + """
SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS rank FROM (
  SELECT term, count(*) AS n FROM terms GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, term LIMIT 50)""")
def document_keywords(spark, d):
    t = v.table(spark, d, "documents").select(F.lit("text").alias("kind"), "text")
    return st.keywords(t, 50)


@query(MSG("""SELECT 'kind' AS level, kind, NULL::BIGINT AS chat, NULL::DATE AS day, NULL::INT AS hour, count(*) AS n FROM msg GROUP BY kind
UNION ALL SELECT 'chat', NULL, chat, NULL, NULL, count(*) FROM msg GROUP BY chat
UNION ALL SELECT 'day', NULL, NULL, ts::DATE, NULL, count(*) FROM msg WHERE ts IS NOT NULL GROUP BY ts::DATE
UNION ALL SELECT 'hour', NULL, NULL, NULL, hour(ts)::INT, count(*) FROM msg WHERE ts IS NOT NULL GROUP BY hour(ts)
UNION ALL SELECT 'all', NULL, NULL, NULL, NULL, count(*) FROM msg"""))
def stats_cube(spark, d):
    return st.stats_cube(v.msg_events(spark, d))


BRIEF = f""", {SRC}, {TERMS},
d AS (SELECT report, ts::DATE AS day, count(*) AS n FROM msg WHERE ts IS NOT NULL GROUP BY 1, 2),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY n DESC, term) AS rank FROM (
  SELECT report, term, count(*) AS n FROM terms GROUP BY 1, 2 HAVING count(*) >= 3)) WHERE rank <= 15),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY n DESC, who) AS rank FROM (
  SELECT report, {WHO} AS who, count(*) AS n FROM msg WHERE kind IN ('text', 'voice', 'image') GROUP BY 1, 2)) WHERE rank <= 8),
parts AS (
  SELECT m.report, 1 AS line, '时间范围：' || min(ts)::DATE || ' ~ ' || max(ts)::DATE || '（活跃 ' || count(DISTINCT ts::DATE) || ' 天）' AS t
    FROM msg m WHERE ts IS NOT NULL GROUP BY 1
  UNION ALL SELECT report, 2, '消息总量：' || count(*) || ' 条（文字 ' || count(*) FILTER (kind = 'text') || ' / 图片 '
    || count(*) FILTER (kind = 'image') || ' / 语音 ' || count(*) FILTER (kind = 'voice') || '）' FROM msg GROUP BY 1
  UNION ALL SELECT report, 3, '各聊天分布：' || string_agg(chat || ' ' || n || ' 条', '，' ORDER BY chat) FROM (
    SELECT report, chat, count(*) AS n FROM msg GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT report, 4, '活跃参与者：' || string_agg(who || ' ' || n || ' 条', '，' ORDER BY rank) FROM sp GROUP BY 1
  UNION ALL SELECT report, 5, '消息峰值日：' || day || '（' || n || ' 条）' FROM (
    SELECT *, row_number() OVER (PARTITION BY report ORDER BY n DESC, day) AS r FROM d) WHERE r = 1
  UNION ALL SELECT report, 6, '高频关键词：' || string_agg(term, '、' ORDER BY rank) FROM kw GROUP BY 1)
"""


@query(MSG("SELECT report, string_agg(t, chr(10) ORDER BY line) AS brief FROM parts GROUP BY 1").replace(
    "\nSELECT report, string_agg(t", BRIEF + "SELECT report, string_agg(t", 1))
def stats_brief(spark, d):
    return st.stats_brief(v.msg_events(spark, d), ["report"])


@query(MSG("SELECT chat, coalesce(strftime(min(ts), '%Y-%m-%d') || ' ~ ' || strftime(max(ts), '%Y-%m-%d'), '') AS coverage FROM msg GROUP BY 1"))
def coverage(spark, d):
    return st.coverage(v.msg_events(spark, d))


@query(MSG(f"""SELECT chat, count(*) FILTER (kind = 'text' AND NOT ({NOISE})) AS n_text, count(*) FILTER (kind = 'image') AS n_image,
  count(*) FILTER (kind = 'voice') AS n_voice,
  coalesce(strftime(min(ts), '%Y-%m-%d') || ' ~ ' || strftime(max(ts), '%Y-%m-%d'), '（无时间标签）') AS span FROM msg GROUP BY 1"""))
def transcript_header(spark, d):
    return st.transcript_header(v.msg_events(spark, d))


@query(v.with_views("""SELECT model, count(*) AS calls, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail,
  floor((sum(prompt_chars) + sum(completion_chars)) / 1.6)::BIGINT AS est_tokens FROM calls GROUP BY 1""", "calls"))
def model_usage(spark, d):
    return st.model_usage(v.call_log(spark, d))


@query(v.with_views("""SELECT model, CASE WHEN error LIKE '%429%' OR error LIKE '%限流%' THEN 'rate_limit' ELSE 'other' END AS error_class,
  count(*) AS n FROM calls WHERE NOT ok GROUP BY 1, 2""", "calls"))
def classify_call_error_counts(spark, d):
    return (v.call_log(spark, d).filter(~F.col("ok"))
            .groupBy("model", classify_call_error("error").alias("error_class")).agg(F.count("*").alias("n")))


@query(v.with_views("""SELECT text, n, row_number() OVER (ORDER BY n DESC, text) AS rank FROM (
  SELECT text, count(*) AS n FROM tokens GROUP BY 1 ORDER BY n DESC, text LIMIT 100)""", "tokens"))
def top_k_tokens(spark, d):
    counts = v.doc_tokens(spark, d).groupBy("text").agg(F.count("*").alias("n"))
    return st.top_k(counts, [], 100, "n", "text")


@query(MSG(f"""SELECT report, row_number() OVER (PARTITION BY report ORDER BY n DESC, who) AS no, who, n FROM (
  SELECT report, {WHO} AS who, count(*) AS n FROM msg WHERE kind IN ('text', 'voice', 'image') GROUP BY 1, 2)"""))
def numbered_rows(spark, d):
    s = st.speaker_counts(v.msg_events(spark, d), ["report"])
    return st.numbered_rows(s, ["report"], [F.col("n").desc(), F.col("who")])


@query(MSG("""SELECT report, no, date, "desc", CASE WHEN lag(substr(date, 1, 7)) OVER (PARTITION BY report ORDER BY no) = substr(date, 1, 7)
  THEN NULL ELSE replace(substr(date, 1, 7), '-', ' 年 ') || ' 月' END AS month_heading FROM (
  SELECT report, strftime(ts, '%Y-%m-%d') AS date, text AS "desc",
    row_number() OVER (PARTITION BY report ORDER BY strftime(ts, '%Y-%m-%d'), event_id) AS no
  FROM msg WHERE kind = 'text' AND ts IS NOT NULL) WHERE no <= 60"""))
def timeline_rows(spark, d):
    p = fl.texts(v.msg_events(spark, d)).select(
        "report", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("text").alias("desc"))
    return timeline(p, ["report"], order=["event_id"])


@query(MSG("""SELECT chat, event_id, image_no FROM (SELECT chat, event_id, row_number() OVER (PARTITION BY chat ORDER BY event_id) AS image_no
FROM msg WHERE kind = 'image') WHERE image_no <= 5"""))
def image_budget_rows(spark, d):
    m = v.msg_events(spark, d).select("chat", "event_id", "kind")
    return image_budget(m, ["chat"], 5, "event_id").select("chat", "event_id", "image_no")


@query(MSG("""SELECT m.event_id, m.chat, coalesce(f.caption, m.text) AS text FROM msg m LEFT JOIN (
  SELECT chat, event_id, 'cap ' || img_path AS caption FROM (
    SELECT chat, event_id, img_path FROM msg WHERE kind = 'image' ORDER BY chat, event_id LIMIT 12)
  WHERE right(img_path, 5) <> '3.png') f USING (chat, event_id)"""))
def apply_captions_rows(spark, d):
    m = v.msg_events(spark, d)
    caps = (m.select("img_path").distinct().filter(~F.col("img_path").endswith("3.png"))
            .withColumn("caption", F.concat(F.lit("cap "), "img_path")))
    return apply_captions(m, caps, order=["chat", "event_id"]).select("event_id", "chat", "text")


@query(MSG("""SELECT report, CASE WHEN report % 3 = 0 THEN '周报' ELSE
  CASE WHEN length(names) > 30 THEN substr(names, 1, 30) || '…' ELSE names END ||
  CASE report % 3 WHEN 1 THEN '工作情况报告' ELSE '分析报告' END END AS title
FROM (SELECT report, string_agg(DISTINCT chat::VARCHAR, '、' ORDER BY chat::VARCHAR) AS names FROM msg GROUP BY 1)"""))
def resolved_title_rows(spark, d):
    title = F.when(F.col("report") % 3 == 0, "周报").otherwise("")
    template = F.when(F.col("report") % 3 == 1, "work").otherwise("memo")
    return report_titles(v.msg_events(spark, d), ["report"], title, template)
