"""Each streaming form, fed in several batches, must give what the batch form gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatloom.functions.text import text_fingerprint
from chatloom.operators import dedup as dd
from chatloom.operators import entities as en
from chatloom.operators import labels as lb
from chatloom.operators.selection import ledger_latest
from chatloom.streaming import sinks as ss
from chatloom.streaming import stateful as sf
from chatloom.streaming import windows as sw

NOW = datetime(2026, 8, 27, 20, 0)


@pytest.fixture
def feed(spark, tmp_path):
    """Stream a frame as one file per value of ``by``, a file per batch."""
    ss.use_durable_state(spark)

    def run(df, by, build):
        src = tmp_path / "in"
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(str(src))
        out = None
        for v in sorted(r[0] for r in df.select(by).distinct().collect()):
            df.filter(F.col(by) == v).coalesce(1).write.mode("append").parquet(str(src))
            # a new query each time: it must resume from the checkpoint
            stream = build(spark.readStream.schema(df.schema).parquet(str(src)))
            out = ss.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"), 120)
        return out
    return run


def test_overlap(spark, feed):
    rng = random.Random(1)
    rows = [(str(c), s, i, rng.choice("abcd"), s // 7) for c in range(4) for s in range(20) for i in range(3)]
    df = spark.createDataFrame(rows, "chat string, screen_idx bigint, cy int, text string, batch int").withColumn("fp", text_fingerprint("text"))
    ranked = dd.occurrence_rank(df, ["chat"]).withColumn("rank", F.col("rank").cast("long"))
    want = dd.dedup_overlap(ranked, ["chat"]).select("chat", "screen_idx", "text", "rank")
    got = feed(ranked, "batch", lambda s: sf.stream_dedup_overlap(s, ["chat"])).filter("NOT late")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_late_screens_are_handed_out(spark, feed):
    df = spark.createDataFrame([("a", 5, "x", "x", 0, 0), ("a", 2, "x", "x", 0, 1)], "chat string, screen_idx bigint, text string, fp string, rank bigint, batch int")
    got = feed(df, "batch", lambda s: sf.stream_dedup_overlap(s, ["chat"])).orderBy("screen_idx").collect()
    assert [(r.screen_idx, r.late) for r in got] == [(2, True), (5, False)]


def test_labels(spark, feed):
    rng = random.Random(2)
    shapes = ["2026年8月5日 14:30", "23:00", "01:00", "12月30日 10:00", "99:99", "09:00", "昨天 14:30"]
    df = spark.createDataFrame([(c, s, 10, rng.choice(shapes), s // 5) for c in range(5) for s in range(15)],
                               "chat int, screen_idx int, cy int, text string, batch int")
    want = lb.resolve_labels(df, NOW, ["chat"])
    got = feed(df, "batch", lambda s: sf.stream_resolve_labels(s, NOW, ["chat"]))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_names(spark, feed):
    rng = random.Random(3)
    pool = ["赵A事务所", "赵嫣嫣AI事务所", "黄春健", "大有咨询王博", "钧棋13674969", "匀棋13674969937"] + [f"群{i}{chr(0x4e00 + 37 * i)}号" for i in range(20)]
    rows = [("l", s, i, n, s // 4) for s in range(12) for i, n in enumerate(rng.sample(pool, 5))]
    df = spark.createDataFrame(rows, "list_id string, screen_idx int, pos int, name string, batch int")
    want = [r.name for r in en.merge_round_names(df, ["list_id"], 6).filter("what = 'name'").orderBy("no").collect()]
    got = feed(df, "batch", lambda s: sf.stream_merge_names(s, ["list_id"], 6))
    best = got.groupBy("no").agg(F.max_by("name", F.length("name")).alias("name")).orderBy("no").collect()
    assert [r.name for r in best] == want


def test_windows_close_with_the_watermark(spark, feed):
    t0 = datetime(2026, 1, 1)
    df = spark.createDataFrame([("u", t0 + timedelta(hours=h), b) for h, b in [(0, 0), (1, 0), (30, 1), (2, 2), (60, 2)]], "u string, ts timestamp_ntz, batch int")
    got = feed(df, "batch", lambda s: sw.stream_counts(s, ["u"], "1 day", "1 hour"))
    # the row of hour 2 comes after the first day was closed
    assert sorted((r.window_start, r.n) for r in got.collect()) == [(t0, 2), (t0 + timedelta(days=1), 1)]


def test_pauses(spark, feed):
    t0 = datetime(2026, 1, 1)
    at = [0, 20, 50, 200, 210, 9000]
    df = spark.createDataFrame([("u", t0 + timedelta(seconds=s), i // 2) for i, s in enumerate(at)], "u string, ts timestamp_ntz, batch int")
    got = feed(df, "batch", lambda s: sw.stream_activity_pauses(s, ["u"], "30 seconds", "1 minute"))
    assert sorted((r.pause_start, r.resume_at, r.n_events) for r in got.collect()) == [
        (t0, t0 + timedelta(seconds=80), 3), (t0 + timedelta(seconds=200), t0 + timedelta(seconds=240), 2)]


def test_sliding_rate(spark, feed):
    t0 = datetime(2026, 1, 1)
    df = spark.createDataFrame([("u", t0 + timedelta(minutes=m), 0) for m in (0, 10, 50, 600)], "u string, ts timestamp_ntz, batch int")
    got = feed(df, "batch", lambda s: sw.stream_rate(s, ["u"]))
    assert {(r.window_start, r.n) for r in got.collect()} == {
        (t0 + timedelta(minutes=m), n) for m, n in [(-45, 2), (-30, 2), (-15, 2), (0, 3), (15, 1), (30, 1), (45, 1)]}


def test_ledger_retries_failures_and_replays_nothing(spark, tmp_path):
    src, led, state = (str(tmp_path / x) for x in ("in", "ledger", "state"))
    schema = "name string, messages bigint, error string, at timestamp_ntz"
    t = lambda i: datetime(2026, 1, 1, i)
    for batch in ([("a", 1, None, t(1)), ("b", 0, "boom", t(1))], [("a", 1, None, t(2)), ("b", 2, None, t(2))], [("b", 9, None, t(3))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        ss.upsert_ledger(spark.readStream.schema(schema).parquet(src), led, state, 120)
    ss.upsert_ledger(spark.readStream.schema(schema).parquet(src), led, state, 120)
    rows = ss.read_ledger(spark, led)
    assert sorted((r.name, r.status, r.at.hour) for r in rows.collect()) == [("a", "done", 1), ("b", "done", 2), ("b", "error", 1)]
    assert {r.name: r.status for r in ledger_latest(rows, ["at"]).collect()} == {"a": "done", "b": "done"}


@pytest.mark.parametrize("size", [4, 1000])
def test_ledger_is_the_same_for_any_batches(spark, tmp_path, size):
    """Failures, retries, repeats, unknown times, a name that is missing; everything fed twice."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), i % 3, rng.choice([None, "boom", "boom", "late"]), datetime(2026, 1, 1, 0, i)) for i in range(12)]
    rows = [("d", 0, "boom", None), ("d", 1, None, None), ("e", 0, "boom", None), *rows, rows[2], rows[5]]
    rows.sort(key=lambda r: (r[3] is not None, r[3] or 0))
    want, done = set(), set()
    for name, n, error, at in rows:
        if name not in done:
            want.add((name, "error" if error else "done", None if error else n, error, at))
            done |= set() if error else {name}
    schema = "name string, messages bigint, error string, at timestamp_ntz"
    src, led = str(tmp_path / "in"), str(tmp_path / "ledger")
    for start in range(0, len(rows), size):
        spark.createDataFrame(rows[start:start + size], schema).coalesce(1).write.mode("append").parquet(src)
    for run in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        ss.upsert_ledger(stream, led, str(tmp_path / f"state{run}"), 300, buckets=5)
    got = [tuple(r) for r in ss.read_ledger(spark, led).select("name", "status", "messages", "error", "at").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_ledger_folder_gets_one_file_a_batch(spark, tmp_path):
    schema = "name string, messages long, error string, at timestamp_ntz"
    src, led = str(tmp_path / "in"), tmp_path / "led"
    rows = [(f"n{i}", i, None, datetime(2026, 1, 1) + timedelta(seconds=i)) for i in range(4000)]
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(src)
    with_rules = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in with_rules}
    try:
        for k, value in with_rules.items():
            spark.conf.set(k, value)
        ss.upsert_ledger(spark.readStream.schema(schema).parquet(src), str(led), str(tmp_path / "state"), 300, buckets=3)
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert ss.read_ledger(spark, str(led)).count() == 4000
    assert [len(list(led.glob(f"bucket={b}/*.parquet"))) for b in range(3)] == [1, 1, 1]


def test_batches_are_dealt_into_files_that_are_never_empty(spark, tmp_path):
    """Few rows, many tasks: each part still has the number of files that makes it one batch."""
    from chatloom.plans.stream_queries import batch_files
    rows = spark.range(0, 200, 1, 6)
    files = batch_files(rows, [150, 50])
    for no, (lo, hi) in enumerate([(0, 150), (150, 200)]):
        part = rows.filter((F.col("id") >= lo) & (F.col("id") < hi))
        part.unionAll(part.filter("id % 3 = 0")).repartition(files).write.parquet(str(tmp_path / f"{no}"))
        assert len(list((tmp_path / f"{no}").glob("*.parquet"))) == files
    assert files == 4 and batch_files(rows, [150, 3]) == 1 and batch_files(rows, [10**6]) == 8 and batch_files(rows, []) == 8


class Calls:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.kept[key] = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.kept


def test_names_on_a_list_are_kept_in_buckets():
    """Batch after batch the state holds every name once, where it is looked for, and is asked far less often than once a name."""
    state, many, all_names = Calls(), 0, []
    for batch, size in enumerate([1, 5, 700, 0, 64, 3000, 1]):
        met = sf._Met(state, many)
        names = [f"群{batch}-{i}" for i in range(size)]
        assert all(n in met for n in all_names[::7]) and not any(n in met for n in names)
        for n in names:
            met.add(n)
        assert all(n in met for n in names)
        before = state.calls
        many = met.write() if met.new else many
        assert state.calls - before <= 2 + 4 * size // 64 + min(size, len(state.kept)) * 2
        all_names += names
        assert many == len(all_names) and sorted(n for v in state.kept.values() for n in v[0]) == sorted(all_names)
    assert len(state.kept) <= many // 32 and max(len(v[0]) for v in state.kept.values()) < 300
    old = Calls()
    old.updateValue(("früher",), (1,))
    assert "früher" in sf._Met(state, many, old) and "später" not in sf._Met(state, many, old)


def test_a_first_batch_asks_the_state_once_a_bucket():
    class Handle:
        def __init__(self):
            self.maps = {}

        def getMapState(self, name, *types):
            return self.maps.setdefault(name, Calls())

        def getListState(self, name, *types):
            return types and type("L", (), {"put": lambda *a: None, "clear": lambda *a: None, "get": lambda *a: iter(())})()

        def getValueState(self, name, *types):
            return type("V", (), {"get": lambda *a: None, "update": lambda *a: None})()

    import pandas as pd

    names = [f"{chr(0x4e00 + i)}{chr(0x6e00 + i)}{chr(0x8000 + i)}" for i in range(4000)]
    handle, op = Handle(), sf._Names(16)
    op.init(handle)
    rows = pd.DataFrame({"screen_idx": [i // 20 for i in range(4000)], "pos": range(4000), "name": names}).sample(frac=1, random_state=1)
    (out,) = op.handleInputRows(("l",), iter([rows[:1500], rows[1500:]]), None)
    assert out["name"].tolist() == names and out["no"].tolist() == list(range(4000))
    assert sum(m.calls for m in handle.maps.values()) <= 4000 // 16
