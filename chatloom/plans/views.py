"""Chat-shaped views of the driver tables, each in Spark (functions) and in SQL (``SQL``)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import number_rows, slice_of
from ..functions.timelabel import wall_seconds
from ..session import settle

EVENTS_AS_OF = datetime(2024, 1, 31, 0, 0, 0)
ORDERS_AS_OF = datetime(2001, 8, 2, 0, 0, 0)
LIST_WIDTH = 248


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def msg_columns(e: DataFrame) -> DataFrame:
    """Events read as messages: a chat per user, a report per sixteen users."""
    i = F.col("event_id")
    t = F.col("event_type")
    kind = F.when(t == "view", "image").when(t == "error", "voice").when(t == "signup", "time").otherwise("text")
    body = (F.when(i % 13 == 0, "86.6K").when(i % 7 == 0, "PDF")
            .when(i % 3 == 0, F.concat(F.lit("现场进度检查 "), t)).otherwise(F.concat(t, F.lit(" "), F.col("props"))))
    text = (F.when(t == "view", F.lit("")).when(t == "error", F.concat((i % 60).cast("string"), F.lit("''")))
            .otherwise(body))
    return e.select(
        F.col("user_id").alias("chat"), F.floor(F.col("user_id") / 16).alias("report"), "event_id",
        F.col("ts").alias("at0"), F.when(i % 11 != 0, F.col("ts")).alias("ts"), kind.alias("kind"), text.alias("text"),
        F.when(i % 3 == 0, "right").otherwise("left").alias("side"),
        F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("u"), (i % 17).cast("string"))).alias("speaker"),
        F.concat(F.lit("img/"), (i % 97).cast("string"), F.lit(".png")).alias("img_path"),
        F.lit("").alias("time_label"))


def msg_events(spark: SparkSession, d: str) -> DataFrame:
    return msg_columns(table(spark, d, "events"))


def with_seq(messages: DataFrame) -> DataFrame:
    """Dense position per chat in time order, numbered in ten-minute slices and stored once, as a reader of
    chat files would find it."""
    return settle(number_rows(messages, ["chat"], slice_of(wall_seconds("at0"), 600), [F.col("at0"), F.col("event_id")]), "messages")


def msg_conv(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("chat"), (F.col("turn") + 1).alias("seq"), F.lit("text").alias("kind"), "text",
                    F.col("role").alias("speaker"), F.when(F.col("role") == "assistant", "right").otherwise("left").alias("side"))


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents read as screens of four lines."""
    t = table(spark, d, "documents")
    return (t.select(F.col("doc_id").alias("chat"), F.posexplode(filled_lines(F.col("text"))).alias("line_no", "text"))
            .select("chat", "line_no", F.floor(F.col("line_no") / 4).alias("screen_idx"),
                    (F.col("line_no") % 4).alias("cy"), "text"))


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return (doc_lines(spark, d)
            .select("chat", "line_no", F.posexplode(F.split("text", " ")).alias("tok_no", "text"))
            .withColumn("pos", F.col("line_no").cast("long") * 100000 + F.col("tok_no")))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Line items read as positioned blocks on list screens, one screen per order."""
    from pyspark.sql import Window

    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    cx = F.col("l_partkey") % LIST_WIDTH
    stamp = F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy/MM/dd")).otherwise(
        F.date_format("l_shipdate", "MM/dd"))
    cy = (12 * F.col("l_quantity")).cast("int")
    return (li.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
            .withColumn("seq", seq)
            .select(F.col("l_orderkey").alias("frame_id"), "seq", F.when(cx > 178, stamp).otherwise(F.col("p_name")).alias("text"),
                    cx.cast("int").alias("cx"), cy.alias("cy"), F.round(F.col("l_discount") * 10, 2).alias("score"),
                    (cx - 5).cast("int").alias("x0"), (cy - 10).alias("y0"), (cx + 40).cast("int").alias("x1"),
                    (cy + 10).alias("y1")))


def event_labels(messages: DataFrame) -> DataFrame:
    """Every fourth message opens with a time label in rotating shapes. Ten messages fill a screen, forty
    high each; a label sits twenty above its message."""
    i = F.floor((F.col("seq") - 1) / 4)
    fmt = lambda f: F.date_format("at0", f)
    text = (F.when(i % 9 == 0, fmt("yyyy'年'M'月'd'日' HH:mm")).when(i % 9 == 1, fmt("HH:mm"))
            .when(i % 9 == 2, fmt("M'月'd'日' HH:mm")).when(i % 9 == 3, fmt("HH:mm:ss"))
            .when(i % 9 == 4, F.concat(F.lit("昨天 "), fmt("HH:mm"))).when(i % 9 == 5, F.concat(F.lit("星期三 "), fmt("HH:mm")))
            .when(i % 9 == 6, fmt("M'月'd'日'")).when(i % 9 == 7, F.lit("24:41")).otherwise(F.lit("2月30日")))
    return (messages.filter((F.col("seq") - 1) % 4 == 0)
            .select("chat", F.floor((F.col("seq") - 1) / 10).alias("screen_idx"),
                    ((F.col("seq") - 1) % 10 * 40 - 20).alias("cy"), text.alias("text")))


def event_screens(messages: DataFrame) -> DataFrame:
    return messages.select("chat", "seq", "event_id", F.floor((F.col("seq") - 1) / 10).alias("screen_idx"),
                           ((F.col("seq") - 1) % 10 * 40).alias("top"))


def list_names(spark: SparkSession, d: str) -> DataFrame:
    """Customers read as chat lists, a list per nation."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_nationkey").alias("list_id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"),
                    "c_custkey")


def list_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Orders read as stamp readings of their customer's chat."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k, fmt = F.col("o_orderkey") % 8, lambda f: F.date_format("o_orderdate", f)
    stamp = (F.when(k == 0, fmt("yyyy/MM/dd")).when(k == 1, fmt("yyyy/MM")).when(k == 2, fmt("yyyy")).when(k == 3, fmt("MM/dd"))
             .when(k == 4, "").when(k == 5, "U4/U/ 1").when(k == 6, F.translate(fmt("yyyy/MM/dd"), "01", "UI")).otherwise("昨天"))
    return (o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"),
                            F.col("c_nationkey").alias("list_id")), "o_custkey")
            .select("list_id", "name", stamp.alias("stamp"), "o_orderdate", "o_orderkey"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Orders read as export results: P and O are successes, F failures."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    ok = F.col("o_orderstatus") != "F"
    return (o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"),
                            F.col("c_nationkey").alias("list_id")), "o_custkey")
            .select("list_id", "name", F.when(ok, "done").otherwise("error").alias("status"),
                    F.when(ok, F.col("o_custkey") % 500).alias("messages"), F.col("o_orderdate").alias("at"),
                    F.col("o_orderkey").alias("seq")))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses read as chat names, a list per top-level domain: site and path without what all
    addresses share. Page variants (anchors, tracking, trailing slashes) give variant readings."""
    return reading_columns(table(spark, d, "pages"))


def reading_columns(pages: DataFrame) -> DataFrame:
    name = F.regexp_replace("url", r"^https?://(?:(?:www|m|blog)\.)?|\.example\.(?:com|org|net)", "")
    return pages.select(F.regexp_extract("url", r"example\.([a-z]+)", 1).alias("list_id"), F.col("page_id").alias("pos"),
                    name.alias("name")).filter("name <> ''")


def call_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(F.col("event_type").alias("model"), (F.col("value") > 3).alias("ok"),
                    (F.get_json_object("props", "$.k").cast("long") * 10).alias("prompt_chars"),
                    (i % 500).alias("completion_chars"),
                    F.when(F.col("value") <= 3, F.when(i % 3 == 0, "HTTP 429 too many").when(i % 3 == 1, "触发限流")
                           .otherwise("timeout")).alias("error"), i.alias("event_id"))


SQL = {
    "msg": """
  SELECT user_id AS chat, user_id // 16 AS report, event_id, ts AS at0,
    CASE WHEN event_id % 11 <> 0 THEN ts END AS ts,
    CASE event_type WHEN 'view' THEN 'image' WHEN 'error' THEN 'voice' WHEN 'signup' THEN 'time' ELSE 'text' END AS kind,
    CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'error' THEN (event_id % 60)::VARCHAR || ''''''
      WHEN event_id % 13 = 0 THEN '86.6K' WHEN event_id % 7 = 0 THEN 'PDF'
      WHEN event_id % 3 = 0 THEN '现场进度检查 ' || event_type ELSE event_type || ' ' || props END AS text,
    CASE WHEN event_id % 3 = 0 THEN 'right' ELSE 'left' END AS side,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE 'u' || (event_id % 17)::VARCHAR END AS speaker,
    'img/' || (event_id % 97)::VARCHAR || '.png' AS img_path,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM events""",
    "lines": """
  SELECT doc_id AS chat, line_no, line_no // 4 AS screen_idx, line_no % 4 AS cy, text FROM (
    SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line_no FROM (
      SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents))""",
    "tokens": """
  SELECT chat, line_no, text, line_no * 100000 + tok_no AS pos FROM (
    SELECT chat, line_no, unnest(ts) AS text, generate_subscripts(ts, 1) - 1 AS tok_no FROM (
      SELECT chat, line_no, string_split(text, ' ') AS ts FROM lines))""",
    "blocks": """
  SELECT l_orderkey AS frame_id, seq, CASE WHEN cx <= 178 THEN p_name
      WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y/%m/%d') ELSE strftime(l_shipdate, '%m/%d') END AS text,
    cx, cy, round(l_discount * 10, 2) AS score, cx - 5 AS x0, cy - 10 AS y0, cx + 40 AS x1, cy + 10 AS y1
  FROM (SELECT l.*, p_name, (l_partkey % 248)::INT AS cx, (12 * l_quantity)::INT AS cy,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq
    FROM lineitem l JOIN part ON p_partkey = l_partkey)""",
    "labels_": """
  SELECT chat, (seq - 1) // 10 AS screen_idx, (seq - 1) % 10 * 40 - 20 AS cy, at0, ((seq - 1) // 4) % 9 AS shape,
    CASE ((seq - 1) // 4) % 9
      WHEN 0 THEN strftime(at0, '%Y年%-m月%-d日 %H:%M') WHEN 1 THEN strftime(at0, '%H:%M')
      WHEN 2 THEN strftime(at0, '%-m月%-d日 %H:%M') WHEN 3 THEN strftime(at0, '%H:%M:%S')
      WHEN 4 THEN '昨天 ' || strftime(at0, '%H:%M') WHEN 5 THEN '星期三 ' || strftime(at0, '%H:%M')
      WHEN 6 THEN strftime(at0, '%-m月%-d日') WHEN 7 THEN '24:41' ELSE '2月30日' END AS text
  FROM msg WHERE (seq - 1) % 4 = 0""",
    "stamps": """
  SELECT c_nationkey AS list_id, c_name AS name, o_orderdate, o_orderkey, CASE o_orderkey % 8
      WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m') WHEN 2 THEN strftime(o_orderdate, '%Y')
      WHEN 3 THEN strftime(o_orderdate, '%m/%d') WHEN 4 THEN '' WHEN 5 THEN 'U4/U/ 1'
      WHEN 6 THEN translate(strftime(o_orderdate, '%Y/%m/%d'), '01', 'UI') ELSE '昨天' END AS stamp
  FROM orders JOIN customer ON c_custkey = o_custkey""",
    "ledger": """
  SELECT c_nationkey AS list_id, c_name AS name, CASE WHEN o_orderstatus <> 'F' THEN 'done' ELSE 'error' END AS status,
    CASE WHEN o_orderstatus <> 'F' THEN o_custkey % 500 END AS messages, o_orderdate AS at, o_orderkey AS seq
  FROM orders JOIN customer ON c_custkey = o_custkey""",
    "calls": """
  SELECT event_type AS model, value > 3 AS ok, (props->>'$.k')::BIGINT * 10 AS prompt_chars, event_id % 500 AS completion_chars,
    CASE WHEN value <= 3 THEN CASE event_id % 3 WHEN 0 THEN 'HTTP 429 too many' WHEN 1 THEN '触发限流' ELSE 'timeout' END END AS error,
    event_id FROM events""",
}
NEEDS = {"tokens": ["lines"], "labels_": ["msg"]}


def with_views(body: str, *names: str, recursive: bool = False, extra: str = "") -> str:
    """``WITH`` clause of the named views (and what they build on) ahead of ``body``."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    ctes = [f"{n} AS ({SQL[n]})" for n in order] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
