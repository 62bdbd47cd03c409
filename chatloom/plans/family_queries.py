"""Name variants over families of names, where SQL can say who belongs together.

Every three customers share eight characters that no other family has (while code points last; see ``OWN``). The readings of a family are these eight, the first
seven, and the eight with two more; a reading with one character exchanged stands for a bad scan. Within a family all are variants of
each other, across families none are.
"""

from pyspark.sql import functions as F

from ..functions.similarity import is_fuzzy_same, is_window_contained
from ..operators import entities as en
from . import views as v
from .registry import query
from .stream_queries import _run, _stream
from ..streaming import stateful as sf

FIRST = 0x20000
#: Families with eight code points of their own. Any two beyond share at most one character, always at the same place: far from a variant.
OWN = (0x110000 - FIRST) // 8
NAMES = f"""n AS (SELECT c_custkey AS pos, c_custkey // 3 AS family, c_custkey // 20 AS screen, b, CASE c_custkey % 3 WHEN 0 THEN b WHEN 1 THEN substr(b, 1, 7) ELSE b || 'xy' END AS name
FROM (SELECT c_custkey, array_to_string(list_transform(range(8), lambda j: chr(({FIRST} + c_custkey // 3 * 8 + j)::INT)), '') AS b FROM customer))"""


def _families(customers):
    """(pos, family, screen_idx, base, name)"""
    c = customers.select(F.col("c_custkey").alias("pos"), F.floor(F.col("c_custkey") / 3).alias("family"), F.floor(F.col("c_custkey") / 20).cast("int").alias("screen_idx"))
    # code points end: later families take their characters from eight earlier ones, no two families the same one twice
    later = F.floor(F.col("family") / OWN)
    whose = lambda j: F.when(F.col("family") < OWN, F.col("family")).otherwise(F.pmod(F.col("family") + later * j, F.lit(OWN)))
    code = lambda j: F.decode(F.unhex(F.lpad(F.hex((whose(j) * 8 + (FIRST + j)).cast("long")), 8, "0")), "UTF-32")
    c = c.withColumn("base", F.concat(*[code(j) for j in range(8)]))
    name = F.when(F.col("pos") % 3 == 0, F.col("base")).when(F.col("pos") % 3 == 1, F.substring("base", 1, 7)).otherwise(F.concat("base", F.lit("xy")))
    return c.withColumn("name", name).withColumn("list_id", F.lit("l"))


def _names(spark, d):
    return _families(v.table(spark, d, "customer"))


def _scanned(names):
    """One reading a family, with its fourth character misread: equal to no other."""
    return names.groupBy("list_id", "family").agg(F.min("base").alias("base")).select(
        "list_id", "family", F.concat(F.substring("base", 1, 3), F.lit("q"), F.substring("base", 5, 4)).alias("name"))


SCANNED = "q AS (SELECT DISTINCT family, substr(b, 1, 3) || 'q' || substr(b, 5, 4) AS name FROM n)"


@query(f"WITH {NAMES} SELECT a.name, o.name AS other FROM n a JOIN n o ON a.family = o.family AND a.name <> o.name")
def variant_pairs_families(spark, d):
    return en.variant_pairs(_names(spark, d), None, ["list_id"]).select("name", "other")


@query(f"WITH {NAMES} SELECT min(pos) AS pos, arg_max(name, length(name)) AS name FROM n GROUP BY family")
def dedupe_names_families(spark, d):
    return en.dedupe_names(_names(spark, d), ["list_id"]).select("pos", "name")


# what resembles the screen before is skipped, so a family grows only on the screen of its first reading
LISTED = f"""{NAMES}, f AS (SELECT family, min(pos) AS first, arg_min(screen, pos) AS screen FROM n GROUP BY 1),
l AS (SELECT f.first, arg_max(n.name, length(n.name)) AS name FROM f JOIN n ON n.family = f.family AND n.screen = f.screen GROUP BY 1)"""


@query(f"""WITH {LISTED} SELECT 'name' AS what, (row_number() OVER (ORDER BY first) - 1)::INT AS no, name, NULL::INT AS new FROM l
UNION ALL SELECT 'round', screen::INT, NULL, (SELECT count(*) FROM f WHERE f.screen = s.screen)::INT FROM (SELECT DISTINCT screen FROM n) s""")
def merge_round_names_families(spark, d):
    """In slices of sixteen screens."""
    return en.merge_round_names(_names(spark, d), ["list_id"], width=16).select("what", "no", "name", "new")


@query(f"WITH {LISTED} SELECT row_number() OVER (ORDER BY first) - 1 AS no, name FROM l")
def stream_merge_names_families(spark, d):
    out = _run(sf.stream_merge_names(_families(_stream(spark, d, "customer")), ["list_id"]))
    return out.groupBy("no").agg(F.max_by("name", F.length("name")).alias("name"))


@query(f"WITH {NAMES}, {SCANNED} SELECT q.name, arg_min(n.name, n.pos) AS matched, 's' || min(n.pos) AS stamp FROM q JOIN n USING (family) GROUP BY 1")
def resolve_stamp_families(spark, d):
    n = _names(spark, d)
    stamps = n.select("list_id", "name", "pos", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("stamp"))
    return en.resolve_stamp(_scanned(n).drop("family"), stamps, ["list_id"]).select("name", "matched", "stamp")


@query(f"""WITH {NAMES}, {SCANNED} SELECT q.name, arg_min(n.name, n.pos) AS matched, CASE WHEN min(n.pos) % 2 = 0 THEN 'done' ELSE 'error' END AS status FROM q JOIN n USING (family) GROUP BY 1
UNION ALL SELECT 'nobody', NULL, NULL""")
def ledger_status_families(spark, d):
    n = _names(spark, d)
    led = n.select("list_id", "name", "pos", F.when(F.col("pos") % 2 == 0, "done").otherwise("error").alias("status"))
    asked = _scanned(n).drop("family").unionByName(spark.createDataFrame([("l", "nobody")], "list_id string, name string"))
    return en.ledger_status(asked, led, ["list_id"]).select("name", "matched", "status")


@query(f"WITH {NAMES} SELECT pos, name FROM n WHERE family IN (2, 5)")
def only_matching_families(spark, d):
    """One is asked for by a part of its name, one by a bad scan."""
    of = lambda f: "".join(chr(FIRST + f * 8 + j) for j in range(8))
    two, five = of(2), of(5)
    return en.only_matching(_names(spark, d), [two[1:6], five[:3] + "q" + five[4:]]).select("pos", "name")


@query(f"""WITH {NAMES}, {SCANNED}, t AS (SELECT family // 10 AS frame, family, name AS target, 2 AS level FROM q WHERE family % 2 = 0
  UNION ALL SELECT DISTINCT family // 10, family, substr(b, 2, 4), 1 FROM n WHERE family % 2 = 1)
SELECT frame, target, arg_min(n.name, n.pos) AS name, level FROM t JOIN n USING (family) GROUP BY frame, target, level""")
def best_match_families(spark, d):
    """Ten families a screen; half of the targets are parts of a name, half bad scans."""
    n = _names(spark, d)
    frame = F.floor(F.col("family") / 10).alias("frame")
    parts = n.filter("family % 2 = 1").select(frame, F.substring("base", 2, 4).alias("target")).distinct()
    scans = _scanned(n).filter("family % 2 = 0").select(frame, F.col("name").alias("target"))
    return en.best_match(parts.unionByName(scans), n.select(frame, "pos", "name"), ["frame"], "pos").select("frame", "target", "name", "level")


# two names with a common start and tails that share nothing match in just that start
TAILS = """p AS (SELECT p_partkey, substr(regexp_replace(p_name, '[^a-z]', '', 'g'), 1, 2 + p_partkey % 9) AS a, p_size % 7 AS i, p_partkey % 5 AS j FROM part),
x AS (SELECT *, length(a) AS k, length(a) + i AS m, length(a) + j AS n FROM p)"""


def _tails(spark, d):
    p = v.table(spark, d, "part")
    a = F.substring(F.regexp_replace("p_name", "[^a-z]", ""), F.lit(1), (F.col("p_partkey") % 9 + 2).cast("int"))
    return p.select("p_partkey", a.alias("a"), F.repeat(F.lit("甲"), (F.col("p_size") % 7).cast("int")).alias("i"), F.repeat(F.lit("乙"), (F.col("p_partkey") % 5).cast("int")).alias("j"))


@query(f"WITH {TAILS} SELECT p_partkey, abs(m - n) <= greatest(2, m // 3) AND 2 * k / (m + n) >= 0.7 AS same FROM x")
def fuzzy_same_tails(spark, d):
    return _tails(spark, d).select("p_partkey", is_fuzzy_same(F.concat("a", "i"), F.concat("a", "j")).alias("same"))


@query(f"WITH {TAILS} SELECT p_partkey, m >= 4 AND m < n + 3 AND k / m >= 0.8 AS inside FROM x")
def window_contains_tails(spark, d):
    t = _tails(spark, d)
    return t.select("p_partkey", is_window_contained(F.concat("a", "i"), F.concat(F.lit("丙丙丙"), "a", "j")).alias("inside"))
