"""Chunks, points and the input of a final synthesis."""

from pyspark.sql import functions as F

from ..operators import mapreduce as mr
from ..operators import stats as st
from ..operators.transcript import image_budget
from . import views as v
from .registry import query
from .stats_queries import BRIEF

LINES = lambda body, **k: v.with_views(body, "lines", **k)
FOLD = """f AS (SELECT chat, line_no, text, length(text) AS size, 0 AS chunk_no FROM lines WHERE line_no = 0
  UNION ALL SELECT l.chat, l.line_no, l.text, CASE WHEN f.size >= 500 THEN 0 ELSE f.size END + length(l.text),
    f.chunk_no + (f.size >= 500)::INT FROM f JOIN lines l ON l.chat = f.chat AND l.line_no = f.line_no + 1)"""
KEY = "array_to_string(list_sort(list_distinct(string_split(text, ''))), '')"


def _lines(spark, d):
    return v.doc_lines(spark, d).select("chat", F.col("line_no").cast("long").alias("seq"), F.col("text").alias("line"))


@query(LINES("""SELECT chat, chunk_no::BIGINT AS chunk_no, string_agg(text, chr(10) ORDER BY line_no) AS text, count(*) AS n_lines,
  sum(length(text))::BIGINT AS n_chars FROM f GROUP BY 1, 2""", recursive=True, extra=FOLD))
def chunk_lines(spark, d):
    return mr.chunk_lines(_lines(spark, d), ["chat"], 500)


@query(LINES("SELECT chat, chunk_no::BIGINT AS chunk_no, count(*) AS n_lines FROM f WHERE chunk_no < 3 GROUP BY 1, 2", recursive=True, extra=FOLD))
def cap_chunks(spark, d):
    n = mr.number_chunks(_lines(spark, d), ["chat"], 500)
    return mr.cap_chunks(n, 3).groupBy("chat", "chunk_no").agg(F.count("*").alias("n_lines"))


# what the rules take from a line does not depend on its chunk
RULES = r"""pt AS (SELECT chat, text, CASE WHEN regexp_matches(text, '\d{4}-\d{2}-\d{2}') THEN 'events'
    WHEN regexp_matches(text, '[?？]\s*$') THEN 'problems' WHEN regexp_matches(text, '[0-9]') THEN 'facts' END AS category FROM lines)"""


@query(LINES("""SELECT chat, category, text AS "desc", count(*) AS n FROM pt WHERE category IS NOT NULL GROUP BY 1, 2, 3""", extra=RULES))
def map_chunks(spark, d):
    chunks = mr.chunk_lines(_lines(spark, d), ["chat"], 2000)
    points = mr.points_of(mr.map_chunks(chunks, ["chat"]), ["chat"])
    return points.groupBy("chat", "category", "desc").agg(F.count("*").alias("n"))


POINTS = f"pt AS (SELECT chat, line_no, CASE line_no % 3 WHEN 0 THEN 'events' WHEN 1 THEN 'facts' ELSE 'todos' END AS category, text, {KEY} AS k FROM lines)"


def _points(spark, d):
    i = F.col("line_no") % 3
    return v.doc_lines(spark, d).select(
        F.when(i == 0, "events").when(i == 1, "facts").otherwise("todos").alias("category"),
        (F.col("chat") * 100000 + F.col("line_no")).alias("pos"), F.col("chat").alias("source"), F.col("text").alias("desc"),
        (F.col("chat") % 10).alias("report"))


@query(LINES("""SELECT chat % 10 AS report, category, k AS merge_key, arg_min(text, chat * 100000 + line_no) AS "desc" FROM pt GROUP BY 1, 2, 3""", extra=POINTS))
def merge_points(spark, d):
    m = mr.merge_points(_points(spark, d), ["report"], ["pos"])
    return m.select("report", "category", "merge_key", "desc")


@query(LINES("SELECT chat % 10 AS report, category, count(DISTINCT k) AS n FROM pt GROUP BY 1, 2", extra=POINTS))
def reduce_points(spark, d):
    return mr.reduce_points(_points(spark, d), ["report"], ["pos"])


@query(LINES("""SELECT report, category, "desc" FROM (SELECT chat % 10 AS report, category, k, arg_min(text, chat * 100000 + line_no) AS "desc" FROM pt GROUP BY 1, 2, 3)""", extra=POINTS))
def points_pages(spark, d):
    """Every entry comes back by reading the pages."""
    merged = mr.merge_points(_points(spark, d), ["report"], ["pos"])
    pages = mr.points_pages(merged, ["report"], ["pos"], 2000)
    each = [F.struct(F.lit(c).alias("category"), F.from_json(F.get_json_object("points", f"$.{c}"), "array<struct<desc: string>>").alias("e")) for c in ("events", "facts", "todos")]
    return (pages.select("report", F.explode(F.array(*each)).alias("x")).select("report", "x.category", F.explode("x.e").alias("e"))
            .select("report", "category", "e.desc"))


DOCUMENT = BRIEF.rstrip() + """,
ep AS (SELECT report, event_id, CASE event_id % 3 WHEN 0 THEN 'events' WHEN 1 THEN 'problems' ELSE 'facts' END AS category,
  strftime(ts, '%Y-%m-%d') AS date, text, """ + KEY + """ AS k FROM msg WHERE kind = 'text' AND ts IS NOT NULL),
mp AS (SELECT report, category, min(event_id) AS event_id, arg_min(date, event_id) AS date, arg_min(text, event_id) AS text FROM ep GROUP BY report, category, k),
js AS (SELECT report, category, string_agg(to_json({'date': date, 'desc': text})::VARCHAR, ', ' ORDER BY event_id) AS j FROM mp GROUP BY 1, 2),
pj AS (SELECT report, substr('{' || string_agg('"' || c.category || '": [' || coalesce(j, '') || ']', ', ' ORDER BY c.o) || '}', 1, 2000) AS points
  FROM (SELECT DISTINCT report FROM js) CROSS JOIN (VALUES (1, 'events'), (2, 'decisions'), (3, 'todos'), (4, 'viewpoints'), (5, 'problems'), (6, 'facts')) c(o, category)
  LEFT JOIN js USING (report, category) GROUP BY 1),
nm AS (SELECT report, count(*) AS c, string_agg(chat::VARCHAR, '、' ORDER BY chat) AS names FROM (SELECT DISTINCT report, chat FROM msg) GROUP BY 1),
br AS (SELECT report, string_agg(t, chr(10) ORDER BY line) AS brief FROM parts GROUP BY 1),
cp AS (SELECT report, string_agg('- cap ' || img_path, chr(10) ORDER BY r) AS caps FROM (
  SELECT report, img_path, row_number() OVER (PARTITION BY report ORDER BY event_id) AS r FROM msg WHERE kind = 'image') WHERE r <= 3 GROUP BY 1)
"""


@query(v.with_views("""SELECT report, '报告类型要求：这是一份工作情况报告：聚焦工作进展、成果、问题与下一步安排。' || chr(10) || chr(10) || '数据来源：' || c || ' 个聊天（'
  || substr(names, 1, 80) || '）' || chr(10) || chr(10) || '统计数据摘要：' || chr(10) || brief || chr(10) || chr(10) || '聊天图片内容：' || chr(10) || caps
  || chr(10) || chr(10) || '分块提取的要点（JSON）：' || chr(10) || points AS document
FROM nm JOIN br USING (report) JOIN cp USING (report) JOIN pj USING (report)""", "msg").replace("\nSELECT report, '报告类型", DOCUMENT + "SELECT report, '报告类型", 1))
def reduce_input(spark, d):
    """The cut form, as its SQL has it; ``reduce_input_pages`` is the whole one."""
    m = v.msg_events(spark, d)
    captions = image_budget(m, ["report"], 3, "event_id").select("report", "image_no", F.concat(F.lit("cap "), "img_path").alias("caption"))
    return mr.reduce_input(m.select("report", "chat"), st.stats_brief(m, ["report"]),
                           mr.points_json(_dated(m), ["report"], ["event_id"], 2000), ["report"], captions=captions, parity=True)


def _dated(m):
    i = F.col("event_id") % 3
    points = m.filter("kind = 'text' AND ts IS NOT NULL").select(
        "report", "event_id", F.when(i == 0, "events").when(i == 1, "problems").otherwise("facts").alias("category"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("text").alias("desc"))
    return mr.merge_points(points, ["report"], ["event_id"])


HEADING = "分块提取的要点（JSON）："


@query(v.with_views(f"""SELECT report, sha256('报告类型要求：这是一份工作情况报告：聚焦工作进展、成果、问题与下一步安排。' || chr(10) || chr(10) || '数据来源：' || c || ' 个聊天（'
  || names || '）' || chr(10) || chr(10) || '统计数据摘要：' || chr(10) || brief || chr(10) || chr(10) || '聊天图片内容：' || chr(10) || caps
  || chr(10) || chr(10) || '{HEADING}' || chr(10)) AS head, category, date, text AS "desc"
FROM nm JOIN br USING (report) JOIN ic USING (report) JOIN mp USING (report)""", "msg").replace("\nSELECT report, sha256(", DOCUMENT.rstrip() + """,
ic AS (SELECT report, string_agg('- cap ' || img_path, chr(10) ORDER BY event_id) AS caps FROM msg WHERE kind = 'image' GROUP BY 1)
SELECT report, sha256(""", 1))
def reduce_input_pages(spark, d):
    """Every entry, chat name and caption comes back by reading the documents."""
    m = v.msg_events(spark, d)
    captions = m.filter("kind = 'image'").select("report", F.col("event_id").alias("image_no"), F.concat(F.lit("cap "), "img_path").alias("caption"))
    docs = mr.reduce_input(m.select("report", "chat"), st.stats_brief(m, ["report"]),
                           mr.points_pages(_dated(m), ["report"], ["event_id"], 2000), ["report"], captions=captions)
    points = F.substring_index("document", HEADING + "\n", -1)
    head = F.substring("document", F.lit(1), F.length("document") - F.length(points))
    each = [F.struct(F.lit(c).alias("category"), F.from_json(F.get_json_object(points, f"$.{c}"), "array<struct<date: string, desc: string>>").alias("e"))
            for c in ("events", "problems", "facts")]
    return (docs.select("report", F.sha2(head, 256).alias("head"), F.explode(F.array(*each)).alias("x"))
            .select("report", "head", "x.category", F.explode("x.e").alias("e")).select("report", "head", "category", "e.date", "e.desc"))
