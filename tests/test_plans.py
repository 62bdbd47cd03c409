"""Registered queries against their SQL, and the plans that matter at scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from chatloom.operators import dedup as dd
from chatloom.operators import filters as fl
from chatloom.plans import views as v

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else repr(round(x, 6))
    return None if x is None else str(x)


def table(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr([norm(r[i]) for i in at]) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name in ORACLES:
        cur = duck.cursor().execute(ORACLES[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert table(df.columns, rows) == table(cols, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def plan(df):
    return df._jdf.queryExecution().toString()


def test_window_bounds_reach_the_scan(spark, data):
    from datetime import datetime
    df = fl.filter_time_window(v.table(spark, data, "events"), "7d", datetime(2024, 1, 20, 12)).select("event_id", "ts")
    p = plan(df)
    assert "PushedFilters: [Or(IsNull(ts)" in p and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p


@pytest.mark.parametrize("name", ["report_overview", "stats_cube", "dedup_overlap", "stats_brief", "keywords", "date_separators", "top_speakers",
                                  "layout_cluster", "list_items", "attribute_speaker", "select_active", "skip_reason", "activity_pauses"])
def test_no_python_in_the_plan(spark, data, name):
    p = plan(QUERIES[name](spark, data))
    assert "InPandas" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "ledger_"))))
def test_no_cross_join(spark, data, name):
    p = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_dedup_is_one_shuffle_after_ranking(spark, data):
    from chatloom.functions.text import text_fingerprint
    ranked = dd.occurrence_rank(v.doc_lines(spark, data).withColumn("fp", text_fingerprint("text")), ["chat"])
    physical = dd.dedup_overlap(ranked, ["chat"])._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 2


def test_composition_is_one_shuffle(spark, data):
    df = dd.compose_messages(v.doc_lines(spark, data), ["chat"])
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_top_k_per_group_limits_before_the_shuffle(spark, data):
    physical = QUERIES["image_budget_rows"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in physical


def test_a_digest_scans_messages_twice(spark, data):
    from chatloom.operators import stats as st
    physical = st.stats_brief(v.msg_events(spark, data), ["report"])._jdf.queryExecution().executedPlan().toString()
    assert physical.count("FileScan parquet") == 2


def test_items_are_planned_once(spark, data):
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    # blocks for the names and blocks for the stamps
    assert scans(QUERIES["list_items"](spark, data)) == 2 * scans(v.blocks(spark, data))


def test_ranges_follow_the_data(spark):
    """A chat without dates holds nine tenths of the rows; no range holds more than a few shares of them."""
    from pyspark.sql import functions as F

    from chatloom.operators import scan
    from chatloom.operators import transcript as tr
    rows = spark.range(40_000).select((F.col("id") % 10 == 0).cast("int").alias("chat"), F.col("id").alias("seq"),
                                      F.when(F.col("id") % 10 == 0, F.timestamp_seconds(F.col("id") % 7)).cast("timestamp_ntz").alias("at"))
    kept = []
    number, scan.number_rows = scan.number_rows, lambda df, *a: (kept.append(df), number(df, *a))[1]
    # small ranges would be put together otherwise
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = tr.reading_position(rows, ["chat"])
    finally:
        scan.number_rows = number
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in kept[0].groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 40_000 / 8 * 2
    got = [(r.chat, r.pos) for r in out.orderBy("chat", F.col("at").asc_nulls_first(), "seq").collect()]
    assert got == [(0, i) for i in range(1, 36_001)] + [(1, i) for i in range(1, 4_001)]
