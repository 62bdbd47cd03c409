"""De-duplication, time labels, reading order, transcripts and activity."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions.text import text_fingerprint, voice_seconds
from ..functions.timelabel import is_time_label, parse_time_label
from ..operators import activity as ac
from ..operators import dedup as dd
from ..operators import filters as fl
from ..operators import labels as lb
from ..operators import transcript as tr
from . import views as v
from .registry import query

LINES = lambda body, **k: v.with_views(body, "lines", **k)
MSG = lambda body, **k: v.with_views(body, "msg", **k)
FP = r"'t|' || md5(regexp_replace(text, '[\s\p{Z}]+', '', 'g'))"
RANKED = f"r AS (SELECT *, row_number() OVER (PARTITION BY chat, screen_idx, fp ORDER BY cy) - 1 AS rank FROM (SELECT *, {FP} AS fp FROM lines))"
KEPT = RANKED + """,
k AS (SELECT * FROM (SELECT *, lag(screen_idx) OVER (PARTITION BY chat, fp, rank ORDER BY screen_idx) AS b FROM r)
  WHERE b IS NULL OR screen_idx - b >= 3)"""


def _ranked(spark, d):
    lines = v.doc_lines(spark, d).withColumn("fp", text_fingerprint("text"))
    return dd.occurrence_rank(lines, ["chat"])


@query(LINES(f"SELECT chat, line_no, {FP} AS fp FROM lines"))
def text_fingerprint_lines(spark, d):
    return v.doc_lines(spark, d).select("chat", "line_no", text_fingerprint("text").alias("fp"))


@query(LINES("SELECT chat, line_no, rank FROM r", extra=RANKED))
def occurrence_rank(spark, d):
    return _ranked(spark, d).select("chat", "line_no", "rank")


@query(LINES("SELECT chat, line_no, screen_idx, rank, text FROM k", extra=KEPT))
def dedup_overlap(spark, d):
    return dd.dedup_overlap(_ranked(spark, d), ["chat"]).select("chat", "line_no", "screen_idx", "rank", "text")


@query(LINES("SELECT chat, count(*) AS n, min(line_no) AS first_line FROM k GROUP BY 1", extra=KEPT))
def compose_messages(spark, d):
    m = dd.compose_messages(v.doc_lines(spark, d), ["chat"])
    return m.groupBy("chat").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


SETS = "s AS (SELECT chat, screen_idx, list_sort(list(DISTINCT text)) AS texts FROM lines GROUP BY 1, 2)"


@query(LINES("SELECT chat, screen_idx, array_to_string(texts, chr(31)) AS texts FROM s", extra=SETS))
def frame_text_set(spark, d):
    s = dd.frame_text_set(v.doc_lines(spark, d), ["chat"])
    return s.select("chat", "screen_idx", F.array_join("texts", "\x1f").alias("texts"))


@query(LINES("""SELECT a.chat, a.screen_idx, len(list_intersect(a.texts, b.texts)) >= least(len(a.texts), len(b.texts)) - 2 AS close
FROM s a JOIN s b ON a.chat = b.chat AND b.screen_idx = a.screen_idx + 1""", extra=SETS))
def frames_close(spark, d):
    s = dd.frame_text_set(v.doc_lines(spark, d), ["chat"]).drop("digest")
    nxt = s.select("chat", (F.col("screen_idx") - 1).alias("screen_idx"), F.col("texts").alias("after"))
    return s.join(nxt, ["chat", "screen_idx"]).select("chat", "screen_idx", dd.frames_close("texts", "after").alias("close"))


@query(MSG("""SELECT chat, screen_idx, stable FROM (SELECT chat, screen_idx,
  sum(same) OVER (PARTITION BY chat ORDER BY screen_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS stable FROM (
  SELECT user_id AS chat, seq - 1 AS screen_idx, coalesce((event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY seq))::INT, 0) AS same
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)))"""))
def stable_screens(spark, d):
    m = v.with_seq(v.msg_columns(v.table(spark, d, "events")))
    kind = v.table(spark, d, "events").select("event_id", F.col("event_type").alias("digest"))
    s = m.join(kind, "event_id").select("chat", (F.col("seq") - 1).alias("screen_idx"), "digest")
    return dd.stable_screens(s, ["chat"]).select("chat", "screen_idx", "stable")


@query(MSG("""SELECT chat, seq FROM msg m LEFT JOIN (SELECT chat, min(seq) AS stop FROM (
  SELECT chat, seq, sum((kind = 'text')::INT) OVER (PARTITION BY chat ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS busy FROM msg)
  WHERE busy = 0 AND seq >= 4 GROUP BY 1) USING (chat) WHERE stop IS NULL OR seq <= stop"""))
def stop_after_idle(spark, d):
    s = v.with_seq(v.msg_events(spark, d)).select(
        "chat", "seq", (F.col("seq") - 1).alias("screen_idx"), F.when(F.col("kind") == "text", 1).otherwise(0).alias("added"))
    return fl.stop_after_idle(s, ["chat"], 4).select("chat", "seq")


# Time a label would have on its own: every shape but the bare clock and the month-day pair is final.
PARTS = """lab AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY screen_idx, cy) AS i, CASE shape
    WHEN 0 THEN date_trunc('minute', at0)
    WHEN 4 THEN TIMESTAMP '2024-01-30 00:00:00' + to_seconds(epoch(date_trunc('minute', at0))::BIGINT % 86400)
    WHEN 5 THEN TIMESTAMP '2024-01-24 00:00:00' + to_seconds(epoch(date_trunc('minute', at0))::BIGINT % 86400) END AS fixed,
    CASE shape WHEN 1 THEN epoch(date_trunc('minute', at0))::BIGINT % 86400 WHEN 3 THEN epoch(date_trunc('second', at0))::BIGINT % 86400 END AS clock,
    CASE shape WHEN 2 THEN date_trunc('minute', at0) WHEN 6 THEN date_trunc('day', at0) END AS this_year
  FROM labels_),
fold AS (
  SELECT chat, i, screen_idx, cy, text, coalesce(fixed, this_year) AS ts FROM lab WHERE i = 1
  UNION ALL
  SELECT n.chat, n.i, n.screen_idx, n.cy, n.text, CASE
    WHEN n.fixed IS NOT NULL THEN n.fixed WHEN n.this_year IS NOT NULL THEN n.this_year
    WHEN n.clock IS NOT NULL THEN date_trunc('day', f.ts) + to_seconds(n.clock)
      + CASE WHEN date_trunc('day', f.ts) + to_seconds(n.clock) < f.ts - INTERVAL 12 HOUR THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
    ELSE f.ts END
  FROM fold f JOIN lab n ON n.chat = f.chat AND n.i = f.i + 1)"""


def _labels(spark, d):
    return v.event_labels(v.with_seq(v.msg_events(spark, d)))


@query(v.with_views("SELECT chat, screen_idx, cy, text, ts FROM fold", "labels_", recursive=True, extra=PARTS))
def resolve_labels(spark, d):
    return lb.resolve_labels(_labels(spark, d), v.EVENTS_AS_OF, ["chat"])


@query(v.with_views("""SELECT m.chat, m.event_id, coalesce(last_value(text IGNORE NULLS) OVER w, '') AS time_label,
  last_value(lts IGNORE NULLS) OVER w AS ts FROM (
    SELECT chat, event_id, (seq - 1) // 10 AS s, (seq - 1) % 10 * 40 AS y, 0 AS l, NULL AS text, NULL::TIMESTAMP AS lts FROM msg
    UNION ALL SELECT chat, NULL, screen_idx, cy, 1, text, ts FROM fold) m
WINDOW w AS (PARTITION BY chat ORDER BY s, y, l ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
QUALIFY event_id IS NOT NULL""",
                    "labels_", recursive=True, extra=PARTS))
def assign_times(spark, d):
    m = v.with_seq(v.msg_events(spark, d))
    resolved = lb.resolve_labels(v.event_labels(m), v.EVENTS_AS_OF, ["chat"])
    return lb.assign_times(v.event_screens(m), resolved, ["chat"]).select("chat", "event_id", "time_label", "ts")


ALONE = """CASE shape WHEN 0 THEN date_trunc('minute', at0) WHEN 2 THEN date_trunc('minute', at0) WHEN 6 THEN date_trunc('day', at0)
    WHEN 1 THEN TIMESTAMP '2024-01-30 00:00:00' + to_seconds(epoch(date_trunc('minute', at0))::BIGINT % 86400)
    WHEN 3 THEN TIMESTAMP '2024-01-30 00:00:00' + to_seconds(epoch(date_trunc('second', at0))::BIGINT % 86400)
    WHEN 4 THEN TIMESTAMP '2024-01-30 00:00:00' + to_seconds(epoch(date_trunc('minute', at0))::BIGINT % 86400)
    WHEN 5 THEN TIMESTAMP '2024-01-24 00:00:00' + to_seconds(epoch(date_trunc('minute', at0))::BIGINT % 86400) END"""


@query(v.with_views(f"SELECT chat, screen_idx, cy, text, {ALONE} AS ts FROM labels_", "labels_"))
def parse_time_label_rows(spark, d):
    return _labels(spark, d).withColumn("ts", parse_time_label("text", v.EVENTS_AS_OF))


@query(v.with_views(f"SELECT chat, screen_idx, min({ALONE}) AS earliest FROM labels_ WHERE {ALONE} IS NOT NULL GROUP BY 1, 2", "labels_"))
def earliest_label(spark, d):
    return lb.earliest_label(_labels(spark, d), v.EVENTS_AS_OF, ["chat"])


@query(v.with_views(f"""SELECT chat, screen_idx FROM (SELECT DISTINCT chat, (seq - 1) // 10 AS screen_idx FROM msg) s LEFT JOIN (
  SELECT chat, min(screen_idx) AS stop FROM (SELECT chat, screen_idx, min({ALONE}) AS e FROM labels_ GROUP BY 1, 2)
  WHERE e > TIMESTAMP '2024-01-20 23:59:59' GROUP BY 1) USING (chat) WHERE stop IS NULL OR screen_idx <= stop""", "labels_"))
def take_until(spark, d):
    m = v.with_seq(v.msg_events(spark, d))
    screens = m.select("chat", F.floor((F.col("seq") - 1) / 10).alias("screen_idx")).distinct()
    early = lb.earliest_label(v.event_labels(m), v.EVENTS_AS_OF, ["chat"])
    s = screens.join(early, ["chat", "screen_idx"], "left")
    return fl.take_until(s, datetime(2024, 1, 20, 23, 59, 59), ["chat"]).select("chat", "screen_idx")


@query(v.with_views(r"""SELECT route, count(*) AS n, sum(secs) AS seconds FROM (
  SELECT 'time' AS route, NULL::INT AS secs FROM labels_
  UNION ALL SELECT CASE WHEN regexp_matches(text, '^\d{1,2}''{1,2}$') THEN 'voice' ELSE 'text' END,
    CASE WHEN regexp_matches(text, '^\d{1,2}''{1,2}$') THEN regexp_extract(text, '^\d+')::INT END FROM msg) GROUP BY 1""", "labels_"))
def route_blocks(spark, d):
    m = v.with_seq(v.msg_events(spark, d))
    both = v.event_labels(m).select("text").unionByName(m.select("text"))
    return (fl.route_blocks(both).groupBy("route")
            .agg(F.count("*").alias("n"), F.sum(voice_seconds("text").cast("long")).alias("seconds")))


@query(v.with_views(r"""SELECT text, regexp_matches(text, '^(\d{4}年)?\d{1,2}月\d{1,2}日( \d{1,2}:\d{2})?$|^(昨天 |星期三 )?\d{1,2}:\d{2}$|^\d{1,2}:\d{2}:\d{2}$') AS is_label,
  count(*) AS n FROM (SELECT text FROM labels_ UNION ALL SELECT text FROM msg) GROUP BY 1, 2""", "labels_"))
def is_time_label_texts(spark, d):
    m = v.with_seq(v.msg_events(spark, d))
    both = v.event_labels(m).select("text").unionByName(m.select("text"))
    return both.groupBy("text", is_time_label("text").alias("is_label")).agg(F.count("*").alias("n"))


ORDERED = "o AS (SELECT *, last_value(ts IGNORE NULLS) OVER (PARTITION BY chat ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS \"at\" FROM m2)"
# a stretch of every chat arrives out of order, as scrolled-back screens do
SHUFFLED = "m2 AS (SELECT * REPLACE (CASE WHEN seq % 7 = 3 THEN ts - INTERVAL 5 DAY ELSE ts END AS ts) FROM msg)"


def _shuffled(spark, d):
    m = v.with_seq(v.msg_events(spark, d))
    back = F.col("ts") - F.expr("interval 5 days")
    return m.withColumn("ts", F.when(F.col("seq") % 7 == 3, back).otherwise(F.col("ts")))


@query(MSG('SELECT chat, seq, "at", row_number() OVER (PARTITION BY chat ORDER BY "at" NULLS FIRST, seq) AS pos FROM o',
           extra=SHUFFLED + ",\n" + ORDERED))
def chrono_order(spark, d):
    o = tr.chrono_order(_shuffled(spark, d), ["chat"])
    return tr.reading_position(o, ["chat"]).select("chat", "seq", "at", "pos")


@query(MSG("""SELECT chat, "at", seq, ts::DATE AS day, strftime(ts, '■ %Y年%m月%d日') AS line FROM (
  SELECT *, row_number() OVER (PARTITION BY chat, ts::DATE ORDER BY "at", seq) AS r FROM o WHERE ts IS NOT NULL) WHERE r = 1""",
           extra=SHUFFLED + ",\n" + ORDERED))
def date_separators(spark, d):
    return tr.date_separators(_shuffled(spark, d), ["chat"])


SHOWN = "CASE WHEN speaker <> '' THEN '【' || speaker || '】' WHEN side = 'right' THEN '【我】' ELSE '' END"


@query(MSG(f"""SELECT chat, "at", seq, 1 AS part, CASE kind
    WHEN 'voice' THEN {SHOWN} || ' 〔语音 ' || text || '〕' || coalesce('　' || strftime(ts, '%H:%M'), '')
    WHEN 'image' THEN {SHOWN} || ' [图片]' || coalesce('　' || strftime(ts, '%H:%M'), '')
    ELSE CASE WHEN {SHOWN} <> '' THEN {SHOWN} || ' ' ELSE '' END || text || coalesce('　' || strftime(ts, '%H:%M'), '') END AS line
  FROM o WHERE kind IN ('voice', 'image') OR text NOT IN ('86.6K', 'PDF')
UNION ALL SELECT chat, "at", seq, 0, strftime(ts, '■ %Y年%m月%d日') FROM (
  SELECT *, row_number() OVER (PARTITION BY chat, ts::DATE ORDER BY "at", seq) AS r FROM o WHERE ts IS NOT NULL) WHERE r = 1""",
           extra=SHUFFLED + ",\n" + ORDERED))
def transcript_lines(spark, d):
    return tr.transcript_lines(_shuffled(spark, d), ["chat"])


MODEL = """CASE kind WHEN 'text' THEN '[' || stamp || '] ' || CASE WHEN speaker <> '' THEN speaker || '：' WHEN side = 'right' THEN '我方：' ELSE '' END || text
  WHEN 'image' THEN '[' || stamp || '] [图片] （图片）' WHEN 'voice' THEN '[' || stamp || '] [语音 ' || text || ']' END"""


@query(MSG(f"SELECT event_id, {MODEL} AS line FROM (SELECT *, coalesce(strftime(ts, '%Y-%m-%d %H:%M'), '') AS stamp FROM msg)"))
def model_line(spark, d):
    return v.msg_events(spark, d).select("event_id", ln.model_line().alias("line"))


@query(MSG(f"""SELECT report, chat, seq, part, line FROM (
  SELECT report, chat, seq, 1 AS part, {MODEL} AS line FROM (SELECT *, coalesce(strftime(ts, '%Y-%m-%d %H:%M'), '') AS stamp FROM msg)
  UNION ALL SELECT DISTINCT report, chat, 0, 0, '===== 聊天来源：' || chat || ' =====' FROM msg) WHERE line IS NOT NULL"""))
def build_transcript(spark, d):
    return tr.build_transcript(v.with_seq(v.msg_events(spark, d)), ["report"])


@query(MSG("""SELECT report, chat, seq, 1 AS part, text AS line FROM msg
UNION ALL SELECT DISTINCT report, chat, 0, 0, '===== 聊天来源：' || chat || ' =====' FROM msg"""))
def merge_chats(spark, d):
    m = v.with_seq(v.msg_events(spark, d)).select("report", "chat", "seq", F.col("text").alias("line"))
    return tr.merge_chats(m, ["report"]).select("report", "chat", "seq", "part", "line")


@query(MSG("""SELECT m.event_id, m.chat, coalesce(f.caption, m.text) AS text FROM msg m LEFT JOIN (
  SELECT chat, event_id, 'a ' || img_path AS caption FROM (SELECT chat, event_id, img_path FROM msg WHERE kind = 'image' ORDER BY chat, event_id LIMIT 40)) f
  USING (chat, event_id)"""))
def repeated_captions(spark, d):
    """Every image path has two captions; each message still comes once."""
    m = v.msg_events(spark, d)
    paths = m.filter("img_path is not null").select("img_path").distinct()
    caps = paths.withColumn("caption", F.explode(F.array(*[F.concat(F.lit(x), "img_path") for x in ("b ", "a ")])))
    return tr.apply_captions(m, caps, 40, ["chat", "event_id"]).select("event_id", "chat", "text")


GAPS = """p AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM (
  SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE)::INT, 1) AS o FROM events))"""


@query(f"""WITH {GAPS} SELECT user_id, no::BIGINT AS pause_no, min(ts) AS pause_start, max(ts) + INTERVAL 30 MINUTE AS resume_at,
  count(*) AS n_events FROM p GROUP BY 1, 2""")
def activity_pauses(spark, d):
    return ac.activity_pauses(v.table(spark, d, "events"), ["user_id"], 1800)


@query(f"WITH {GAPS} SELECT user_id, max(no)::BIGINT AS n_pauses, (max(no) + 1)::BIGINT AS n_resumes FROM p GROUP BY 1")
def pause_counts(spark, d):
    return ac.pause_counts(ac.activity_pauses(v.table(spark, d, "events"), ["user_id"], 1800), ["user_id"])


@query(v.with_views("""SELECT list_id, screen_idx, cy, cx, seq, text, row_number() OVER (PARTITION BY list_id ORDER BY screen_idx, cy, seq) AS pos
FROM (SELECT *, frame_id // 4 AS list_id, frame_id % 4 AS screen_idx FROM blocks)""", "blocks"))
def sort_messages(spark, d):
    b = v.blocks(spark, d).withColumn("list_id", F.floor(F.col("frame_id") / 4)).withColumn("screen_idx", F.col("frame_id") % 4)
    return dd.sort_messages(b, ["list_id"]).select("list_id", "screen_idx", "cy", "cx", "seq", "text", "pos")
