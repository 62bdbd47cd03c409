"""Chat files, sinks, loosely formatted JSON and vectors."""

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lines import parse_json_loose
from ..functions.vectors import vector_dhash, vectors_equal, vectors_relate
from ..operators import report as rp
from ..operators import stats as st
from ..session import shared_dir
from ..sources import chats as ch
from ..sources import registry as rg
from ..sources import sinks as sk
from . import views as v
from .order_queries import MSG, SHOWN
from .registry import query
from .stats_queries import NOISE, WHO


@query("""SELECT conv_id::VARCHAR AS chat, turn + 1 AS seq, 'text' AS kind, text, role AS speaker,
  CASE WHEN role = 'assistant' THEN 'right' ELSE 'left' END AS side FROM conversations""")
def chat_files_round_trip(spark, d):
    path = shared_dir(spark, "chats")
    ch.write_chats(v.msg_conv(spark, d), path)
    return ch.read_chats(spark, path, multi_line=False).select("chat", "seq", "kind", "text", "speaker", "side")


@query(MSG("SELECT chat::VARCHAR AS chat, seq, kind, text, date_trunc('second', ts) AS ts, speaker, side FROM msg"))
def chat_parts_round_trip(spark, d):
    """Chats stored in parts of twenty messages."""
    path = shared_dir(spark, "chats")
    ch.write_chats(v.with_seq(v.msg_events(spark, d)), path, rows_per_part=20)
    docs = ch.read_documents(spark, path, multi_line=False)
    return ch.explode_messages(docs, 20).select("chat", "seq", "kind", "text", "ts", "speaker", "side")


@query("""SELECT 'c' || (conv_id % 50)::VARCHAR AS chat, turn + 1 AS seq, text FROM conversations
JOIN (SELECT max(conv_id) AS conv_id FROM conversations GROUP BY conv_id % 50) USING (conv_id)""")
def register_alias(spark, d):
    docs = ch.nest_chats(v.msg_conv(spark, d)).withColumn("loaded", F.col("name").cast("long"))
    named = docs.withColumn("alias", F.concat(F.lit("c"), (F.col("loaded") % 50).cast("string")))
    return ch.explode_messages(ch.register_alias(named, "loaded")).select("chat", "seq", "text")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) END AS ts FROM events""")
def parse_message_ts(spark, d):
    e, k = v.table(spark, d, "events"), F.col("event_id") % 5
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    stored = (F.when(k == 0, text).when(k == 1, F.concat(text, F.lit(".123456"))).when(k == 2, "").when(k == 3, "2024-13-40 00:00:00"))
    return e.select("event_id", ch.parse_message_ts(stored).alias("ts"))


@query(MSG("""SELECT chat, event_id, kind, ts FROM msg
WHERE ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 23:59:59'"""))
def extract_source(spark, d):
    rg.register_source("events", lambda s, path: v.msg_events(s, path).withColumn("seq", F.col("event_id")))
    m = rg.extract(spark, "events", window="2024-01-05~2024-01-09", as_of=datetime(2024, 2, 1), path=d)
    return m.select("chat", "event_id", "kind", "ts")


@query(MSG(f"""SELECT chat || '-' || substr(md5(chat::VARCHAR), 1, 12) AS chat, line FROM (
  SELECT chat, CASE kind WHEN 'voice' THEN {SHOWN} || ' 〔语音 ' || text || '〕' || coalesce('　' || strftime(ts, '%H:%M'), '')
    WHEN 'image' THEN {SHOWN} || ' [图片]' || coalesce('　' || strftime(ts, '%H:%M'), '')
    ELSE CASE WHEN {SHOWN} <> '' THEN {SHOWN} || ' ' ELSE '' END || text || coalesce('　' || strftime(ts, '%H:%M'), '') END AS line
  FROM msg WHERE kind IN ('voice', 'image') OR text NOT IN ('86.6K', 'PDF')
  UNION ALL SELECT DISTINCT chat, strftime(ts, '■ %Y年%m月%d日') FROM msg WHERE ts IS NOT NULL)"""))
def write_transcript(spark, d):
    """A folder per chat, named by the safe name and a digest of the full one."""
    path = shared_dir(spark, "transcripts")
    sk.write_transcript(v.with_seq(v.msg_events(spark, d)), path)
    return spark.read.schema("value string, chat string").text(path).select("chat", F.col("value").alias("line"))


@query(MSG(f"""SELECT 'speakers' AS section, report, rank AS no, who AS item, n::VARCHAR AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY report ORDER BY n DESC, who) AS rank FROM (
    SELECT report, {WHO} AS who, count(*) AS n FROM msg WHERE kind IN ('text', 'voice', 'image') GROUP BY 1, 2)) WHERE rank <= 10
UNION ALL SELECT 'overview', report, 1, '消息总量', count(*) || ' 条' FROM msg GROUP BY report
UNION ALL SELECT 'overview', report, 2, '文字消息', count(*) FILTER (kind = 'text') || ' 条' FROM msg GROUP BY report
UNION ALL SELECT 'overview', report, 3, '图片消息', count(*) FILTER (kind = 'image') || ' 条' FROM msg GROUP BY report
UNION ALL SELECT 'overview', report, 4, '语音消息', count(*) FILTER (kind = 'voice') || ' 条' FROM msg GROUP BY report
UNION ALL SELECT 'overview', report, 5, '活跃天数', count(DISTINCT ts::DATE) || ' 天' FROM msg GROUP BY report
UNION ALL SELECT 'overview', report, 6, '消息峰值日', d::VARCHAR || '（' || n || ' 条）' FROM (
  SELECT *, row_number() OVER (PARTITION BY report ORDER BY n DESC, d) AS r FROM (
    SELECT report, ts::DATE AS d, count(*) AS n FROM msg WHERE ts IS NOT NULL GROUP BY 1, 2)) WHERE r = 1"""))
def write_report_tables(spark, d):
    m, path = v.msg_events(spark, d), shared_dir(spark, "report")
    sk.write_report_tables({"overview": st.report_overview(m, ["report"]), "speakers": st.top_speakers(m, by=["report"])}, path)
    o, s = spark.read.parquet(f"{path}/overview"), spark.read.parquet(f"{path}/speakers")
    text = lambda c: F.col(c).cast("string")
    return (o.select(F.lit("overview").alias("section"), "report", "no", F.col("metric").alias("item"), "value")
            .unionByName(s.select(F.lit("speakers").alias("section"), "report", F.col("rank").alias("no"),
                                  F.col("who").alias("item"), text("n").alias("value"))))


def _replies(m):
    """A synthesis reply per report, made of its messages: plain, fenced, among prose, without sections, unreadable."""
    per = m.groupBy("report", "chat").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))
    text = lambda c: F.col(c).cast("string")
    one = F.struct("chat", F.struct(F.concat(F.lit("第 "), text("chat"), F.lit(" 节")).alias("heading"),
                                    F.array(F.concat(text("n"), F.lit(" 条")), F.concat(F.lit("首 "), text("least"))).alias("paras")).alias("s"))
    g = per.groupBy("report").agg(F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("sections"))
    r, k = text("report"), F.col("report") % 5
    said = lambda *more: F.to_json(F.struct(F.concat(F.lit("报告 "), r).alias("title"), F.concat(F.lit("共 "), text("n"), F.lit(" 条")).alias("summary"), *more,
                                            F.array(F.concat(F.lit("结论 "), r)).alias("conclusions"), F.concat(F.lit("建议 "), r).alias("suggestions")))
    whole = said(F.col("sections"))
    reply = (F.when(k == 0, whole).when(k == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), whole, F.lit(" - done")))
             .when(k == 3, said()).otherwise(F.concat(F.lit("no answer: "), r)))
    return g.select("report", reply.alias("reply"), F.to_json(F.struct("n")).alias("points"))


@query(MSG("""SELECT report, '报告 ' || report AS title, '共 ' || count(*) || ' 条' AS summary FROM msg WHERE report % 5 < 4 GROUP BY report
UNION ALL SELECT DISTINCT report, '', 'no answer: ' || report FROM msg WHERE report % 5 = 4"""))
def report_content(spark, d):
    r = _replies(v.msg_events(spark, d))
    return rp.report_content(r.select("report", "reply"), ["report"], r.select("report", "points")).select("report", "title", "summary")


@query(MSG("""SELECT * FROM (
SELECT 'sections' AS section, report, no, unnest([1, 2]) AS part, '第 ' || chat || ' 节' AS item, unnest([n || ' 条', '首 ' || least]) AS value
  FROM (SELECT report, chat, count(*) AS n, min(event_id) AS least, row_number() OVER (PARTITION BY report ORDER BY chat) AS no FROM msg GROUP BY 1, 2) WHERE report % 5 < 3
UNION ALL SELECT 'sections', report, 1, 1, '一、聊天记录要点', '{"n":' || count(*) || '}' FROM msg WHERE report % 5 > 2 GROUP BY report
UNION ALL SELECT DISTINCT 'conclusions', report, 1, 1, 'conclusion', '结论 ' || report FROM msg WHERE report % 5 < 4
UNION ALL SELECT DISTINCT 'conclusions', report, 1, 1, 'suggestion', '建议 ' || report FROM msg WHERE report % 5 < 4
UNION ALL SELECT 'timeline', report, row_number() OVER (PARTITION BY report ORDER BY date, event_id), 1, date, text FROM (
  SELECT *, strftime(ts, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY report ORDER BY event_id) AS r FROM msg WHERE kind = 'text' AND ts IS NOT NULL) WHERE r <= 30
UNION ALL SELECT 'images', report, row_number() OVER (PARTITION BY report ORDER BY event_id), 1, img_path,
  '图 ' || row_number() OVER (PARTITION BY report ORDER BY event_id) || '　cap ' || img_path FROM msg WHERE kind = 'image')"""))
def report_sections(spark, d):
    """Four of the seven tables of a report, written and read back; the other three have queries of their own."""
    m, path = v.msg_events(spark, d), shared_dir(spark, "report")
    r = _replies(m)
    dated = m.filter("kind = 'text' AND ts IS NOT NULL").select("report", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("text").alias("desc"))
    first = dated.withColumn("r", F.row_number().over(Window.partitionBy("report").orderBy("event_id"))).filter("r <= 30")
    items = F.transform(F.array_sort(F.collect_list(F.struct("r", F.struct("date", "desc").alias("e")))), lambda x: x["e"])
    lines = first.groupBy("report").agg(F.concat(F.lit("```json\n"), F.to_json(F.struct(items.alias("items"))), F.lit("```")).alias("reply"))
    captions = m.filter("kind = 'image'").select("report", F.col("event_id").alias("image_no"), "img_path", F.concat(F.lit("cap "), "img_path").alias("caption"))
    tables = rp.report_tables(m, r.select("report", "reply"), ["report"], r.select("report", "points"), lines, captions=captions)
    sk.write_report_tables({k: tables[k] for k in ("sections", "conclusions", "timeline", "images")}, path)
    shape = {"sections": ("no", "para_no", "heading", "para"), "conclusions": ("no", None, "part", "text"),
             "timeline": ("no", None, "date", "desc"), "images": ("no", None, "img_path", "caption")}
    out = None
    for name, (no, part, item, value) in shape.items():
        t = spark.read.parquet(f"{path}/{name}").select(
            F.lit(name).alias("section"), "report", F.col(no).cast("long").alias("no"), (F.col(part) if part else F.lit(1)).cast("long").alias("part"),
            F.col(item).alias("item"), F.col(value).alias("value"))
        out = t if out is None else out.unionByName(t)
    return out


@query(MSG(f"""SELECT chat, unnest([0, 1, 2]) AS head_no, unnest([chat || ' · 聊天记录', '导出时间：2024-02-01 08:30　·　时间窗：全部可见记录（实际覆盖 '
  || CASE WHEN chat % 3 = 0 THEN 'stored ' || chat ELSE coalesce(strftime(min(ts), '%Y-%m-%d') || ' ~ ' || strftime(max(ts), '%Y-%m-%d'), '（无时间标签）') END
  || '）　·　文字 ' || count(*) FILTER (kind = 'text' AND NOT ({NOISE})) || ' 条 / 图片 ' || count(*) FILTER (kind = 'image') || ' 张 / 语音 ' || count(*) FILTER (kind = 'voice') || ' 条',
  '（视觉自动化截图 + OCR 提取，严格只读；语音仅记录时长）']) AS line FROM msg GROUP BY chat"""))
def transcript_heads(spark, d):
    m = v.msg_events(spark, d)
    stored = m.select("chat").distinct().withColumn("coverage", F.when(F.col("chat") % 3 == 0, F.concat(F.lit("stored "), F.col("chat").cast("string"))).otherwise(""))
    return rp.head_lines(m, datetime(2024, 2, 1, 8, 30), coverage=stored)


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (props->>'$.k')::BIGINT END AS k, CASE WHEN event_id % 4 = 3 THEN 'no answer: ' || event_type END AS raw
FROM events""")
def parse_json_loose_replies(spark, d):
    e, k = v.table(spark, d, "events"), F.col("event_id") % 4
    reply = (F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
             .when(k == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" - done"))).otherwise(F.concat(F.lit("no answer: "), "event_type")))
    return (e.select("event_id", parse_json_loose(reply).alias("j"))
            .select("event_id", F.try_variant_get("j.value", "$.k", "bigint").alias("k"), F.col("j.raw").alias("raw")))


@query("""SELECT vec_id, 'i|' || list_reduce(list_transform(range(2, len(embedding) + 1), lambda i: CASE WHEN embedding[i] > embedding[i - 1] THEN '1' ELSE '0' END),
  lambda a, b: a || b) AS hash FROM embeddings""")
def vector_dhash_rows(spark, d):
    return v.table(spark, d, "embeddings").select("vec_id", vector_dhash("embedding").alias("hash"))


PAIRS = "p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"""WITH {PAIRS} SELECT vec_id, list_avg(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) < 0.14 AS same FROM p""")
def vectors_equal_pairs(spark, d):
    return _neighbours(spark, d).select("vec_id", vectors_equal("x", "y", 0.14).alias("same"))


@query(f"""WITH {PAIRS}, c AS (SELECT vec_id, list_transform(x, lambda q: q - list_avg(x)) AS x, list_transform(y, lambda q: q - list_avg(y)) AS y FROM p)
SELECT vec_id, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) AS relation FROM c""")
def vectors_relate_pairs(spark, d):
    return _neighbours(spark, d).select("vec_id", F.round(vectors_relate("x", "y"), 6).alias("relation"))


def _neighbours(spark, d):
    e = v.table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e.select("vec_id", F.col("embedding").alias("x")).join(nxt, "vec_id")
