"""Screen layout, stamps, entity resolution and selection."""

from datetime import date

from pyspark.sql import functions as F

from ..functions.similarity import is_subseq_drop, shared_digit_run
from ..functions.stamps import is_stamp, norm_stamp_digits, stamp_older_than
from ..functions.text import norm_name, safe_name, strip_fused_suffix
from ..operators import entities as en
from ..operators import filters as fl
from ..operators import layout as lo
from ..operators import selection as se
from ..operators.dedup import overlap_prev_screen
from ..sources.blocks import place_blocks
from ..sources.sinks import ledger_rows
from . import views as v
from .registry import query

BLK = lambda body, **k: v.with_views(body, "blocks", **k)
CUTOFF = date(2000, 6, 1)


@query(BLK("SELECT frame_id, seq, text, x0, y0, x1, y1, ((2 * x0 + 2 * x1) / 4)::INT AS cx, cy, score FROM blocks WHERE score >= 0.5").replace(
    "((2 * x0 + 2 * x1) / 4)::INT", "trunc((x0 + x1) / 2)::INT"))
def read_blocks(spark, d):
    b = v.blocks(spark, d)
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    box = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    return place_blocks(b.select("frame_id", "seq", "text", box.alias("box"), "score"))


@query(BLK("SELECT frame_id, seq, text, score >= 0.4 AS for_name, TRUE AS for_stamp FROM blocks WHERE score >= 0.28"))
def tiered_threshold(spark, d):
    return fl.tiered_threshold(v.blocks(spark, d)).select("frame_id", "seq", "text", "for_name", "for_stamp")


CLEAN = "c AS (SELECT * FROM blocks WHERE score >= 0.4 AND cy >= 22)"


@query(BLK("SELECT frame_id, seq, text FROM blocks WHERE cy >= 22 AND NOT (cx > 178 AND regexp_matches(text, '^\\d+$'))"))
def layout_denoise(spark, d):
    return fl.layout_denoise(v.blocks(spark, d), v.LIST_WIDTH).select("frame_id", "seq", "text")


CLUSTER = CLEAN + """,
g AS (SELECT *, cy - lag(cy) OVER (PARTITION BY frame_id ORDER BY cy, seq) AS gap FROM c),
ln AS (SELECT *, coalesce(sum((gap > 10)::INT) OVER w, 0) AS line FROM g WINDOW w AS (PARTITION BY frame_id ORDER BY cy, seq ROWS UNBOUNDED PRECEDING)),
edge AS (SELECT frame_id, line, min(cy) - 10 AS top, max(cy) + 10 AS bottom FROM ln GROUP BY 1, 2),
br AS (SELECT *, coalesce((top - lag(bottom) OVER (PARTITION BY frame_id ORDER BY line) > 12)::INT, 0) AS opens FROM edge),
it AS (SELECT frame_id, line, sum(opens) OVER (PARTITION BY frame_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS item FROM br),
k AS (SELECT ln.*, item FROM ln JOIN it USING (frame_id, line))"""


@query(BLK("SELECT frame_id, seq, line::BIGINT AS line, item::BIGINT AS item FROM k", extra=CLUSTER))
def layout_cluster(spark, d):
    b = fl.layout_denoise(v.blocks(spark, d).filter("score >= 0.4"), v.LIST_WIDTH)
    return lo.layout_cluster(b, ["frame_id"]).select("frame_id", "seq", "line", "item")


# the stamp texts of these blocks: a date with or without the year
NAMES = CLUSTER + r""",
first AS (SELECT frame_id, item, min(line) AS line FROM k GROUP BY 1, 2),
lead AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY frame_id, item ORDER BY cx, cy, seq) AS r,
    min(cy) OVER (PARTITION BY frame_id, item) AS row_y FROM k JOIN first USING (frame_id, item, line)) WHERE r = 1),
-- a full date loses its month and day to the fused stamp, as any name would
n AS (SELECT frame_id, item, row_y, CASE WHEN regexp_matches(text, '^\d{4}/\d{2}/\d{2}$') THEN substr(text, 1, 5) ELSE text END AS name,
  CASE WHEN regexp_matches(text, '^\d{4}/\d{2}/\d{2}$') THEN substr(text, 6) ELSE '' END AS fused FROM lead WHERE length(text) >= 2)"""
STAMPED = NAMES + r""",
near AS (SELECT n.frame_id, n.item, b.text, row_number() OVER (PARTITION BY n.frame_id, n.item ORDER BY b.seq) AS r
  FROM n JOIN blocks b ON b.frame_id = n.frame_id AND b.score >= 0.28 AND b.cx > 178 AND abs(b.cy - n.row_y) <= 10
   AND regexp_matches(b.text, '^(\d{4}/\d{2}/\d{2}|\d{2}/\d{2})$')),
i AS (SELECT n.*, coalesce(near.text, fused) AS stamp FROM n LEFT JOIN near ON n.frame_id = near.frame_id AND n.item = near.item AND r = 1)"""


@query(BLK("SELECT frame_id, item::BIGINT AS item, row_y, name FROM n", extra=NAMES))
def item_name(spark, d):
    b = fl.layout_denoise(v.blocks(spark, d).filter("score >= 0.4"), v.LIST_WIDTH)
    out = lo.item_name(lo.layout_cluster(b, ["frame_id"]), ["frame_id"])
    return out.select("frame_id", "item", "row_y", "name")


@query(BLK("SELECT frame_id, item::BIGINT AS item, name, stamp FROM i", extra=STAMPED))
def list_items(spark, d):
    out = lo.list_items(v.blocks(spark, d), ["frame_id"], v.LIST_WIDTH)
    return out.select("frame_id", "item", "name", "stamp")


@query(BLK("""SELECT b.frame_id, b.seq, CASE WHEN b.cx > 126.48 THEN 'right' ELSE 'left' END AS side, coalesce(s.text, '') AS speaker,
  u.seq IS NOT NULL AS is_nickname FROM blocks b LEFT JOIN s USING (frame_id, seq)
  LEFT JOIN (SELECT DISTINCT frame_id, nseq AS seq FROM s) u USING (frame_id, seq)""", extra="""
s AS (SELECT * FROM (SELECT b.frame_id, b.seq, t.text, t.seq AS nseq, row_number() OVER (PARTITION BY b.frame_id, b.seq ORDER BY b.y0 - t.y1, t.seq) AS r
  FROM blocks b JOIN blocks t ON b.frame_id = t.frame_id AND b.seq <> t.seq AND b.cx <= 126.48 AND length(t.text) <= 12 AND t.cx <= 124
    AND b.y0 - t.y1 BETWEEN 4 AND 44 AND abs(t.x0 - b.x0) < 90) WHERE r = 1)"""))
def attribute_speaker(spark, d):
    out = lo.attribute_speaker(v.blocks(spark, d), ["frame_id"], v.LIST_WIDTH)
    return out.select("frame_id", "seq", "side", "speaker", "is_nickname")


BOXES = """bx AS (SELECT DISTINCT l_orderkey AS frame_id, (l_partkey % 300)::INT AS x, (12 * l_quantity)::INT AS y,
  (40 + l_suppkey % 60)::INT AS w, (30 + l_linenumber * 10)::INT AS h FROM lineitem)"""


def _boxes(spark, d):
    li = v.table(spark, d, "lineitem")
    i = lambda c: c.cast("int")
    return li.select(F.col("l_orderkey").alias("frame_id"), i(F.col("l_partkey") % 300).alias("x"),
                     i(12 * F.col("l_quantity")).alias("y"), i(40 + F.col("l_suppkey") % 60).alias("w"),
                     i(30 + F.col("l_linenumber") * 10).alias("h")).distinct()


@query(BLK("""SELECT frame_id, x, y, w, h FROM bx WHERE NOT EXISTS (SELECT 1 FROM blocks t WHERE t.frame_id = bx.frame_id
  AND least(x + w, x1) > greatest(x, x0) AND least(y + h, y1) > greatest(y, y0)
  AND (least(x + w, x1) - greatest(x, x0)) * (least(y + h, y1) - greatest(y, y0)) / ((x1 - x0) * (y1 - y0)) > 0.4)""", extra=BOXES))
def box_overlap_anti(spark, d):
    return lo.box_overlap_anti(_boxes(spark, d), v.blocks(spark, d), ["frame_id"])


MEETS = """(greatest(0, least(k.x1, c.x1) - greatest(k.x0, c.x0)) * greatest(0, least(k.y1, c.y1) - greatest(k.y0, c.y0))) / greatest(1,
  (k.x1 - k.x0) * (k.y1 - k.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - greatest(0, least(k.x1, c.x1) - greatest(k.x0, c.x0)) * greatest(0, least(k.y1, c.y1) - greatest(k.y0, c.y0))) > 0.3
  OR (k.x0 <= c.x0 AND k.y0 <= c.y0 AND c.x1 <= k.x1 AND c.y1 <= k.y1) OR (c.x0 <= k.x0 AND c.y0 <= k.y0 AND k.x1 <= c.x1 AND k.y1 <= c.y1)"""


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT frame_id, list({{'x0': x, 'y0': y, 'x1': x + w, 'y1': y + h}} ORDER BY y, x, w, h) AS b FROM bx GROUP BY 1),
f AS (SELECT frame_id, b, 1 AS n, b[:0] AS kept FROM o UNION ALL
  SELECT frame_id, b, n + 1, CASE WHEN place = 0 THEN list_append(kept, c) ELSE list_transform(kept, lambda k, i: CASE WHEN i = place
    THEN {{'x0': least(k.x0, c.x0), 'y0': least(k.y0, c.y0), 'x1': greatest(k.x1, c.x1), 'y1': greatest(k.y1, c.y1)}} ELSE k END) END
  FROM (SELECT *, coalesce(list_position(list_transform(kept, lambda k: {MEETS}), true), 0) AS place FROM (SELECT *, b[n] AS c FROM f WHERE n <= len(b))))
SELECT frame_id, i - 1 AS box_no, k.x0 AS x, k.y0 AS y, k.x1 - k.x0 AS w, k.y1 - k.y0 AS h
FROM (SELECT frame_id, unnest(kept) AS k, generate_subscripts(kept, 1) AS i FROM f WHERE n = len(b) + 1)""")
def merge_boxes(spark, d):
    return lo.merge_boxes(_boxes(spark, d), ["frame_id"])


@query("SELECT p_partkey, regexp_replace(p_type || ' · ' || p_name, '[\\s·]+', '', 'g') AS norm FROM part")
def norm_name_parts(spark, d):
    p = v.table(spark, d, "part")
    return p.select("p_partkey", norm_name(F.concat("p_type", F.lit(" · "), "p_name")).alias("norm"))


@query("""SELECT p_partkey, substr(regexp_replace(regexp_replace(p_brand || ' / 项目群:' || p_name || '!', '[^\\p{L}\\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS safe FROM part""")
def safe_name_parts(spark, d):
    p = v.table(spark, d, "part")
    return p.select("p_partkey", safe_name(F.concat("p_brand", F.lit(" / 项目群:"), "p_name", F.lit("!"))).alias("safe"))


@query(v.with_views("""SELECT list_id, name, stamp, replace(translate(stamp, 'UI', '01'), ' ', '') AS digits,
  regexp_matches(stamp, '^(\\d{4}/\\d{2}(/\\d{2})?|\\d{2}/\\d{2}|昨天)$') OR
  regexp_matches(replace(translate(stamp, 'UI', '01'), ' ', ''), '^(19|20)\\d{2}/\\d{2}(/\\d{2})?$') AS is_stamp
FROM (SELECT DISTINCT list_id, name, stamp FROM stamps)""", "stamps"))
def stamp_readings(spark, d):
    s = v.list_stamps(spark, d).select("list_id", "name", "stamp").distinct()
    return s.select("list_id", "name", "stamp", norm_stamp_digits("stamp").alias("digits"), is_stamp("stamp").alias("is_stamp"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Order' || o_custkey || '群' WHEN 1 THEN 'Order' || o_custkey || '群'
    WHEN 2 THEN 'Order' || o_custkey || '群' ELSE '3-2班' END AS name,
  CASE o_orderkey % 4 WHEN 1 THEN strftime(o_orderdate, '%Y/%m') WHEN 2 THEN strftime(o_orderdate, '%m/%d') ELSE '' END AS stamp FROM orders""")
def strip_fused_suffix_orders(spark, d):
    o, k = v.table(spark, d, "orders"), F.col("o_orderkey") % 4
    name = F.concat(F.lit("Order"), F.col("o_custkey").cast("string"), F.lit("群"))
    raw = (F.when(k == 0, F.concat(name, F.lit("昨天14:12"))).when(k == 1, F.concat(name, F.lit("..."), F.date_format("o_orderdate", "yyyy/MM")))
           .when(k == 2, F.concat(name, F.lit("…"), F.date_format("o_orderdate", "MM/dd"))).otherwise("3-2班"))
    return o.select("o_orderkey", strip_fused_suffix(raw).alias("c")).select("o_orderkey", "c.name", "c.stamp")


# as_of 2001-08-02: a month and day after it belong to the year before
OLDER = """CASE o_orderkey % 8 WHEN 0 THEN o_orderdate::DATE < DATE '2000-06-01' WHEN 6 THEN o_orderdate::DATE < DATE '2000-06-01'
  WHEN 1 THEN date_trunc('month', o_orderdate)::DATE < DATE '2000-06-01'
  WHEN 2 THEN CASE WHEN year(o_orderdate) <> 2000 THEN year(o_orderdate) < 2000 END
  WHEN 3 THEN CASE WHEN strftime(o_orderdate, '%m%d') = '0229' THEN NULL
    WHEN strftime(o_orderdate, '%m%d') > '0802' THEN strftime(o_orderdate, '2000%m%d') < '20000601' ELSE FALSE END
  WHEN 7 THEN FALSE END"""


@query(v.with_views(f"SELECT o_orderkey, stamp, {OLDER} AS older FROM stamps", "stamps"))
def stamp_older_than_rows(spark, d):
    s = v.list_stamps(spark, d)
    return s.select("o_orderkey", "stamp", stamp_older_than("stamp", CUTOFF, v.ORDERS_AS_OF.date()).alias("older"))


LATEST = "latest AS (SELECT list_id, name, arg_max(stamp, (o_orderdate, o_orderkey)) AS stamp, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM stamps WHERE stamp <> '' GROUP BY 1, 2)"


def _latest(spark, d):
    return lo.stamps_latest(v.list_stamps(spark, d), ["o_orderdate", "o_orderkey"], ["list_id", "name"])


@query(v.with_views("SELECT list_id, name, stamp FROM latest", "stamps", extra=LATEST))
def stamps_latest(spark, d):
    return _latest(spark, d)


@query(v.with_views("""SELECT c_nationkey AS list_id, c_custkey AS pos, c_name AS name, CASE WHEN stamp IS NOT NULL THEN c_name END AS matched, stamp
FROM customer LEFT JOIN latest ON list_id = c_nationkey AND name = c_name""", "stamps", extra=LATEST))
def resolve_stamp(spark, d):
    out = en.resolve_stamp(v.list_names(spark, d), _latest(spark, d), ["list_id"], variants=False)
    return out.select("list_id", "pos", "name", "matched", "stamp")


STATUS = "st AS (SELECT list_id, name, arg_max(status, (\"at\", seq)) AS status FROM ledger GROUP BY 1, 2)"


def _status(spark, d):
    return se.ledger_latest(v.ledger(spark, d), ["at", "seq"], ["list_id"])


@query(v.with_views("""SELECT c_nationkey AS list_id, c_custkey AS pos, c_name AS name, status FROM customer
LEFT JOIN st ON list_id = c_nationkey AND name = c_name""".replace("c_name AS name, status", "c_name AS name, st.status"), "ledger", extra=STATUS))
def ledger_status(spark, d):
    out = en.ledger_status(v.list_names(spark, d), _status(spark, d), ["list_id"], variants=False)
    return out.select("list_id", "pos", "name", "status")


@query(v.with_views("SELECT c_custkey AS pos, c_name AS name FROM customer ANTI JOIN (SELECT * FROM st WHERE status = 'done') s ON s.list_id = c_nationkey AND s.name = c_name",
                    "ledger", extra=STATUS))
def to_do_names(spark, d):
    done = se.drop_failed(_status(spark, d)).select("list_id", "name")
    return v.list_names(spark, d).join(done, ["list_id", "name"], "left_anti").select("pos", "name")


@query("SELECT c_custkey AS pos, c_name AS name FROM customer WHERE contains(c_name, '00001') OR contains(c_name, '777') OR contains('Customer#000000005 (群)', c_name)")
def only_matching(spark, d):
    out = en.only_matching(v.list_names(spark, d), ["00001", "777", "Customer#000000005 (群)"], variants=False, require=False)
    return out.select("pos", "name")


@query(BLK("""SELECT t.frame_id, t.target, arg_min(b.text, b.seq) AS name, 1 AS level FROM (
  SELECT frame_id, split_part(text, ' ', 1) AS target FROM blocks WHERE seq = 1) t JOIN blocks b
  ON b.frame_id = t.frame_id AND (contains(b.text, t.target) OR contains(t.target, b.text)) GROUP BY 1, 2"""))
def best_match(spark, d):
    b = v.blocks(spark, d).select("frame_id", "seq", F.col("text").alias("name"))
    t = b.filter("seq = 1").select("frame_id", F.split_part("name", F.lit(" "), F.lit(1)).alias("target"))
    return en.best_match(t, b, ["frame_id"], variants=False)


JUDGED = LATEST + """, j AS (SELECT c_nationkey AS list_id, c_custkey AS pos, c_name AS name, s.stamp, CASE WHEN s.stamp IS NULL THEN NULL ELSE """ + OLDER + """ END AS older
  FROM customer LEFT JOIN latest s ON s.list_id = c_nationkey AND s.name = c_name LEFT JOIN orders ON o_orderkey = s.k),
kept AS (SELECT * FROM j WHERE older IS NOT TRUE)"""


@query(v.with_views("""SELECT list_id, pos, name FROM kept LEFT JOIN (SELECT list_id, max(pos) AS cut FROM kept WHERE older = FALSE GROUP BY 1) USING (list_id)
WHERE cut IS NULL OR pos <= cut""", "stamps", extra=JUDGED))
def select_active(spark, d):
    out = se.select_active(v.list_names(spark, d), _latest(spark, d), "2000-06-01~", v.ORDERS_AS_OF, ["list_id"], variants=False)
    return out.select("list_id", "pos", "name")


@query(v.with_views("""SELECT list_id, pos, name FROM kept LEFT JOIN (SELECT list_id, max(pos) AS cut FROM kept WHERE older = FALSE GROUP BY 1) USING (list_id)
WHERE cut IS NULL OR pos <= cut""", "stamps", extra=JUDGED))
def tail_cut(spark, d):
    s = en.resolve_stamp(v.list_names(spark, d), _latest(spark, d), ["list_id"], variants=False)
    judged = s.withColumn("older", stamp_older_than("stamp", CUTOFF, v.ORDERS_AS_OF.date()))
    return se.tail_cut(judged.filter(~F.coalesce("older", F.lit(False))), ["list_id"]).select("list_id", "pos", "name")


@query(v.with_views("""SELECT pos, name, CASE WHEN name = 'Customer#000000003' THEN 'system'
  WHEN NOT (contains(name, '#00000') OR contains(name, '9')) THEN 'not-only' WHEN st.status = 'error' THEN 'error'
  WHEN st.status = 'done' THEN 'done' WHEN older THEN 'old' END AS reason
FROM j LEFT JOIN st USING (list_id, name)""", "stamps", "ledger", extra=JUDGED + ", " + STATUS))
def skip_reason(spark, d):
    n = en.resolve_stamp(v.list_names(spark, d), _latest(spark, d), ["list_id"], variants=False).drop("matched")
    n = en.ledger_status(n, _status(spark, d), ["list_id"], variants=False)
    out = se.skip_reason(n, CUTOFF, v.ORDERS_AS_OF.date(), ("Customer#000000003",), ["#00000", "9"], variants=False)
    return out.select("pos", "name", "reason")


@query(v.with_views("""SELECT list_id, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped, coalesce(messages, 0) AS messages FROM (
  SELECT list_id, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS failed, sum(messages)::BIGINT AS messages FROM ledger GROUP BY 1)
FULL JOIN (SELECT list_id, count(*) AS skipped FROM st WHERE status = 'done' GROUP BY 1) USING (list_id)""", "ledger", extra=STATUS))
def batch_summary(spark, d):
    skipped = _status(spark, d).filter("status = 'done'")
    return se.batch_summary(v.ledger(spark, d), skipped, ["list_id"])


@query(v.with_views("""SELECT list_id, seq, done, failed, messages, (epoch("at") - epoch(start))::BIGINT // done AS mean_seconds FROM (
  SELECT list_id, seq, status, "at", min("at") OVER (PARTITION BY list_id) AS start,
    count(*) FILTER (status = 'done') OVER w AS done, count(*) FILTER (status = 'error') OVER w AS failed,
    coalesce(sum(messages) OVER w, 0)::BIGINT AS messages
  FROM ledger WINDOW w AS (PARTITION BY list_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE status = 'done' AND done % 5 = 0"""
                    .replace('(epoch("at") - epoch(start))::BIGINT // done', 'floor((epoch("at") - epoch(start)) / done)::BIGINT'), "ledger"))
def progress_every_n(spark, d):
    return se.progress_every_n(v.ledger(spark, d), ["list_id"])


@query(v.with_views("""SELECT name, status, messages, CASE WHEN status = 'error' THEN substr(repeat('导出失败 ', 60) || seq, 1, 200) END AS error, "at" FROM ledger""", "ledger"))
def ledger_rows_cut(spark, d):
    r = v.ledger(spark, d)
    err = F.when(F.col("status") == "error", F.concat(F.repeat(F.lit("导出失败 "), 60), F.col("seq").cast("string")))
    return ledger_rows(r.withColumn("error", err), 200)


@query("SELECT c_custkey AS pos, c_name AS name FROM customer ORDER BY c_custkey LIMIT 100")
def limit_chats(spark, d):
    return se.limit_chats(v.list_names(spark, d), 100).select("pos", "name")


@query(BLK("""SELECT a.list_id, a.screen_idx, a.name FROM (SELECT DISTINCT frame_id // 4 AS list_id, frame_id % 4 AS screen_idx, text AS name FROM blocks) a
ANTI JOIN (SELECT frame_id // 4 AS list_id, frame_id % 4 AS screen_idx, text AS name FROM blocks) b
ON a.list_id = b.list_id AND b.screen_idx = a.screen_idx - 1 AND a.name = b.name"""))
def overlap_prev_screen_items(spark, d):
    b = v.blocks(spark, d).select(F.floor(F.col("frame_id") / 4).alias("list_id"), (F.col("frame_id") % 4).alias("screen_idx"),
                                  F.col("text").alias("name")).distinct()
    return overlap_prev_screen(b, ["list_id"])


@query("""SELECT a.c_custkey AS pos, len(list_filter(regexp_extract_all(a.c_name, '\\d{6,}'), lambda x: len(list_filter(
  regexp_extract_all(b.c_name || '0', '\\d{6,}'), lambda y: contains(x, y) OR contains(y, x))) > 0)) > 0 AS shared
FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey * 10""")
def shared_digit_run_pairs(spark, d):
    c = v.list_names(spark, d).select("pos", "name")
    b = c.select(F.col("pos").alias("tenfold"), F.concat("name", F.lit("0")).alias("other"))
    return (c.join(b, F.col("pos") * 10 == F.col("tenfold"))
            .select("pos", shared_digit_run("name", "other").alias("shared")))


@query("""SELECT page_id AS pos, length(n) >= 5 AS dropped FROM (SELECT page_id, regexp_replace(regexp_replace(
  url, '^https?://((www|m|blog)\\.)?|\\.example\\.(com|org|net)', '', 'g'), '[\\s\\p{Z}·.。:：()（）\\[\\]【】\\-—_]+', '', 'g') AS n FROM pages)""")
def subseq_drop_readings(spark, d):
    # leaving out one character after the second makes a reading of any name that keeps four
    n = norm_name("name")
    cut = F.concat(F.substring(n, F.lit(1), F.lit(2)), F.substring(n, F.lit(4), F.length(n)))
    return v.readings(spark, d).select("pos", is_subseq_drop(cut, n).alias("dropped"))


@query()
def variant_pairs(spark, d):
    r = v.readings(spark, d)
    return en.variant_pairs(r, None, ["list_id"])


@query()
def dedupe_names(spark, d):
    return en.dedupe_names(v.readings(spark, d), ["list_id"])


@query()
def merge_round_names(spark, d):
    r = v.readings(spark, d).withColumn("screen_idx", F.floor(F.col("pos") / 20).cast("int"))
    return en.merge_round_names(r, ["list_id"])


def _shortened(spark, d):
    r = v.readings(spark, d)
    cut = F.concat(F.substring("name", F.lit(1), F.lit(3)), F.substring("name", F.lit(5), F.length("name")))
    return r.withColumn("name", F.when(F.col("pos") % 2 == 0, cut).otherwise(F.col("name"))).dropDuplicates(["list_id", "name"])


@query()
def resolve_stamp_variants(spark, d):
    stamps = v.readings(spark, d).groupBy("list_id", "name").agg(F.min("pos").alias("pos"), F.lit("昨天").alias("stamp"))
    return en.resolve_stamp(_shortened(spark, d).select("list_id", "name"), stamps, ["list_id"])


@query()
def ledger_status_variants(spark, d):
    done = v.readings(spark, d).groupBy("list_id", "name").agg(F.min("pos").alias("pos"), F.lit("done").alias("status"))
    return en.ledger_status(_shortened(spark, d).select("list_id", "name"), done, ["list_id"])


@query()
def only_matching_variants(spark, d):
    return en.only_matching(v.readings(spark, d), ["ththin/en/671", "spam-farm/es"], require=False)


@query()
def best_match_variants(spark, d):
    b = v.blocks(spark, d).select("frame_id", "seq", F.col("text").alias("name"))
    t = b.filter("seq = 1").select("frame_id", F.concat(F.substring("name", 1, 4), F.substring("name", 6, 20)).alias("target"))
    return en.best_match(t, b, ["frame_id"])
