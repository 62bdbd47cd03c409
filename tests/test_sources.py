import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chatloom.operators import stats as st
from chatloom.sources import blocks as bl
from chatloom.sources import chats as ch
from chatloom.sources import registry as rg
from chatloom.sources import sinks as sk


def test_reads_indented_files_and_fills_defaults(spark, tmp_path):
    for name in ("群一", "群二"):
        (tmp_path / f"{name}.json").write_text(json.dumps({
            "name": name, "captured_at": "x", "extra": 1, "messages": [
                {"kind": "text", "text": "早", "timestamp": "2026-08-05 14:30:00.5", "box": [1, 2, 3, 4], "unknown": {"a": 1}},
                {"text": "坏时间", "timestamp": "昨天"}, {"kind": "voice"}]}, ensure_ascii=False, indent=1), encoding="utf-8")
    rows = ch.read_chats(spark, str(tmp_path)).orderBy("chat", "seq").collect()
    assert [(r.chat, r.seq, r.kind, r.text, r.ts) for r in rows[:3]] == [
        ("群一", 1, "text", "早", datetime(2026, 8, 5, 14, 30)), ("群一", 2, "text", "坏时间", None), ("群一", 3, "voice", "", None)]
    assert rows[0].box == [1, 2, 3, 4] and rows[1].box == [0, 0, 0, 0] and rows[1].screen_idx == 0 and len(rows) == 6


def test_round_trip_in_parts(spark, tmp_path):
    m = spark.createDataFrame([("a", i, "text", f"m{i}\n", datetime(2026, 1, 1, 0, i)) for i in range(1, 8)] + [("b", 1, "image", "", None)],
                              "chat string, seq int, kind string, text string, ts timestamp_ntz")
    chats = spark.createDataFrame([("a", "2026-01-01", "7d", "c")], "name string, captured_at string, time_window string, coverage string")
    ch.write_chats(m, str(tmp_path / "o"), chats, rows_per_part=3)
    docs = ch.read_documents(spark, str(tmp_path / "o"), multi_line=False)
    assert sorted((r.name, r.part, len(r.messages), r.time_window) for r in docs.collect()) == [
        ("a", 0, 3, "7d"), ("a", 1, 3, "7d"), ("a", 2, 1, "7d"), ("b", 0, 1, "")]
    back = ch.explode_messages(docs, 3).select("chat", "seq", "kind", "text", "ts")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, m.collect()), key=str)


def test_alias_replaces_earlier_load(spark):
    docs = spark.createDataFrame([("a", "", 1), ("b", "a", 2), ("c", None, 3)], "name string, alias string, loaded int")
    assert sorted((r.name, r.loaded) for r in ch.register_alias(docs, "loaded").collect()) == [("a", 2), ("c", 3)]


def test_a_load_without_an_order_is_kept(spark):
    docs = spark.createDataFrame([("a", "", None), ("b", "", None), ("b", "", 4), (None, None, 5)], "name string, alias string, loaded int")
    assert sorted((r.name, r.loaded) for r in ch.register_alias(docs, "loaded").collect()) == [("", 5), ("a", None), ("b", 4)]


def test_blocks(spark, tmp_path):
    rows = [(1, 1, " 你好 ", [[0, 0], [11, 0], [11, 9], [0, 9]], .9), (1, 2, "低", [[0, 0]] * 4, .3), (1, 3, "  ", [[0, 0]] * 4, .9)]
    spark.createDataFrame(rows, "frame_id bigint, seq bigint, text string, box array<array<int>>, score double").write.json(str(tmp_path / "b"))
    out = bl.read_blocks(spark, str(tmp_path / "b"), .5, "json").collect()
    assert [(r.text, r.x0, r.y0, r.x1, r.y1, r.cx, r.cy) for r in out] == [("你好", 0, 0, 11, 9, 5, 4)]


def test_plug_in_source(spark):
    m = spark.createDataFrame([("a", 1, "text", "t", datetime(2026, 1, 1), "", ""), ("b", 1, "text", "t", None, "", "")],
                              "chat string, seq int, kind string, text string, ts timestamp_ntz, speaker string, side string")
    rg.register_source("mine", lambda s: m)
    assert rg.extract(spark, "mine", ["b"]).count() == 1
    assert rg.extract(spark, "mine", window="2027-01", as_of=datetime(2027, 2, 1)).count() == 1
    with pytest.raises(KeyError):
        rg.extract(spark, "missing")
    rg.register_source("broken", lambda s: m.drop("ts"))
    with pytest.raises(ValueError):
        rg.extract(spark, "broken")


def test_transcript_files_keep_the_order(spark, tmp_path):
    rows = [("群/一", i, "text", f"第{i}条", datetime(2026, 1, 1 + i // 20, 0, i % 60), "", "left", "") for i in range(100)]
    m = spark.createDataFrame(rows, "chat string, seq int, kind string, text string, ts timestamp_ntz, speaker string, side string, time_label string")
    sk.write_transcript(m, str(tmp_path / "t"), files=4)
    (folder,) = (tmp_path / "t").glob("chat=群_一-*")
    files = sorted(folder.glob("part-*"))
    assert len(files) > 1
    lines = [x for f in files for x in f.read_text(encoding="utf-8").splitlines()]
    assert [x.split("　")[0] for x in lines if not x.startswith("■")] == [f"第{i}条" for i in range(100)]
    assert sum(x.startswith("■") for x in lines) == 5


def test_ledger_rows(spark, tmp_path):
    r = spark.createDataFrame([("a", 5, None, datetime(2026, 1, 1)), ("b", 7, "x" * 300, datetime(2026, 1, 1))],
                              "name string, messages int, error string, at timestamp_ntz")
    sk.ledger_append(r, str(tmp_path / "l"), 200)
    sk.ledger_append(r.filter("name = 'a'"), str(tmp_path / "l"))
    out = spark.read.parquet(str(tmp_path / "l")).orderBy("name").collect()
    assert [(x.name, x.status, x.messages, len(x.error or "")) for x in out] == [("a", "done", 5, 0), ("a", "done", 5, 0), ("b", "error", None, 200)]


def test_brief_and_counts(spark):
    m = spark.createDataFrame([(1, "a", "text", "项目推进", datetime(2026, 8, 5, 9), "甲", "left"), (1, "a", "text", "项目推进", datetime(2026, 8, 5, 10), "", "right"),
                               (1, "a", "image", "", None, "", "left"), (1, "a", "voice", "3''", datetime(2026, 8, 6), "甲", "left"),
                               (1, "a", "time", "x", None, "", "left"), (1, "a", "text", "项目推进 the and Abc", None, "", "left")],
                              "report int, chat string, kind string, text string, ts timestamp_ntz, speaker string, side string")
    brief = st.stats_brief(m, ["report"]).first().brief
    assert brief == ("时间范围：2026-08-05 ~ 2026-08-06（活跃 2 天）\n消息总量：6 条（文字 3 / 图片 1 / 语音 1）\n"
                     "活跃参与者：其他 2 条，甲 2 条，我方 1 条\n消息峰值日：2026-08-05（2 条）\n高频关键词：推进、目推、项目")
    assert {r.term for r in st.keyword_counts(m).collect()} == {"项目", "目推", "推进", "the", "and", "abc"}
    assert {r.term for r in st.keyword_counts(m, parity=True).collect()} == {"项目", "目推", "推进"}
    empty = st.stats_brief(m.filter("kind = 'time'"), ["report"]).first().brief
    assert empty == "消息总量：1 条（文字 0 / 图片 0 / 语音 0）"


def test_overview_of_nothing_dated(spark):
    m = spark.createDataFrame([("text", None)], "kind string, ts timestamp_ntz")
    assert [r.value for r in st.report_overview(m).orderBy("no").collect()] == ["1 条", "1 条", "0 条", "0 条", "0 天", "—"]


def test_stop_words_split_pairs(spark):
    t = spark.createDataFrame([("我们的项目",), ("今天项目",)], "x string")
    got = [r.t for r in t.select(st.keyword_terms(F.col("x")).alias("t")).collect()]
    assert got == [["项目"], ["天项", "项目"]]
    assert t.select(st.keyword_terms(F.col("x"), parity=True).alias("t")).collect()[1].t == ["今天", "天项", "项目"]


def test_chats_with_like_names_get_their_own_folders(spark, tmp_path):
    rows = [(c, 1, "text", c, datetime(2026, 1, 1), "", "left", "") for c in ("群 A", "群/A")]
    m = spark.createDataFrame(rows, "chat string, seq int, kind string, text string, ts timestamp_ntz, speaker string, side string, time_label string")
    sk.write_transcript(m, str(tmp_path / "t"))
    texts = ["".join(f.read_text(encoding="utf-8") for f in d.glob("part-*")) for d in (tmp_path / "t").glob("chat=*")]
    assert len(texts) == 2 and all(("群 A" in t) != ("群/A" in t) for t in texts)


def test_transcripts_are_what_the_text_writer_writes(spark, tmp_path):
    """Many chats, one of them large, names and texts with odd characters, and none: the same lines in the same folders, without a checksum file each."""
    rows = [(c, i, "text", t, datetime(2026, 1, 1 + i % 3, 0, i % 60), "", "left", "") for c in ["群/一", "a b", "a/b", None, "x" * 90, *map(str, range(40))]
            for i, t in enumerate(["早", "", None, "tab\tand\r", "emoji 😀"])]
    rows += [("large", i, "text", f"l{i}", datetime(2026, 1, 1, 0, i % 60), "", "left", "") for i in range(3000)]
    m = spark.createDataFrame(rows, "chat string, seq int, kind string, text string, ts timestamp_ntz, speaker string, side string, time_label string")
    new, old = tmp_path / "new", tmp_path / "old"
    sk.write_transcript(m, str(new), files=6)
    old.mkdir()
    sk.write_transcript(m, f"file:{old}", files=6, mode="append")  # a folder that is there is left to Spark
    read = lambda at: {d.name: b"".join(f.read_bytes() for f in sorted(d.glob("part-*"))) for d in at.glob("chat=*")}
    assert read(new) == read(old) and len(read(new)) == 46
    assert len(list(new.glob("chat=large-*/part-*"))) > 1 and not list(new.rglob(".*.crc"))
    assert sorted(p.name for p in new.iterdir() if not p.name.startswith("chat=")) == ["_SUCCESS"]
    assert spark.read.text(str(new)).count() == spark.read.text(str(old)).count()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sk.write_transcript(m, str(new))


def test_a_transcript_that_fails_leaves_nothing(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, "text", "t", datetime(2026, 1, 1), "", "left", "")],
                              "chat string, seq int, kind string, text string, ts timestamp_ntz, speaker string, side string, time_label string")
    with pytest.raises(Exception, match="broken"):
        sk.write_transcript(m.withColumn("text", F.raise_error(F.lit("broken"))), str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


def test_whole_errors_by_default(spark):
    r = spark.createDataFrame([("b", 7, "x" * 300, datetime(2026, 1, 1))], "name string, messages int, error string, at timestamp_ntz")
    assert len(sk.ledger_rows(r).first().error) == 300


def test_a_window_needs_a_moment(spark):
    with pytest.raises(ValueError):
        rg.extract(spark, "chat_files", window="7d")


def stored(tmp_path, names, multi_line):
    """Chat documents with odd fields, a file each or a line each."""
    docs = [{"name": n, "captured_at": "x", "extra": 1, "part": i % 2, "messages": [
        {"kind": "text", "text": f"{n} 早", "timestamp": "2026-08-05 14:30:00.5", "box": [1, 2, 3, 4], "unknown": {"a": 1}},
        {"text": "坏时间", "timestamp": "昨天", "speaker": None}, {"kind": "voice", "screen_idx": 3, "timestamp": "2024-13-40 00:00:00"}]} for i, n in enumerate(names)]
    docs += [{"name": None, "messages": [{"text": "no name"}]}, {"name": "empty", "messages": []}]
    if multi_line:
        for i, doc in enumerate(docs):
            (tmp_path / f"{i}.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1), encoding="utf-8")
    else:
        (tmp_path / "all.json").write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in docs) + "\n", encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path)


@pytest.mark.parametrize("multi_line, task_bytes", [(True, 1), (True, 1 << 20), (False, 1 << 20)])
def test_plug_in_reads_like_the_json_reader(spark, tmp_path, multi_line, task_bytes):
    from chatloom.sources.plugin import use_chat_source

    path = stored(tmp_path, [f"群{i}" for i in range(7)], multi_line)
    name = use_chat_source(spark)
    got = spark.read.format(name).option("multiLine", multi_line).option("taskBytes", task_bytes).load(path)
    want = ch.read_chats(spark, path, multi_line)
    assert [f.name for f in got.schema] == [f.name for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    some = got.filter(F.col("chat").isin("群1", "群2") & (F.col("kind") == "voice"))
    assert sorted(r.chat for r in some.collect()) == ["群1", "群2"]
    assert rg.extract(spark, name, ["群3"], path=path, multiLine=multi_line).count() == 3
    assert got.rdd.getNumPartitions() == (9 if task_bytes == 1 else 1)


def test_plug_in_streams_new_files_once(spark, tmp_path):
    import os

    from chatloom.sources.plugin import use_chat_source
    from chatloom.streaming.sinks import run_to_files

    folder = tmp_path / "in"
    folder.mkdir()
    path = stored(folder, ["a", "b"], True)
    run = lambda: run_to_files(spark.readStream.format(use_chat_source(spark)).load(path), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert run().count() == 7
    late = folder / "late.json"
    late.write_text(json.dumps({"name": "c", "messages": [{"text": "x"}]}))
    os.utime(late, (4e9, 4e9))
    again = run()
    assert again.count() == 8 and again.filter("chat = 'c'").count() == 1
    assert run().count() == 8
    want = ch.read_chats(spark, path)
    assert sorted(map(str, again.collect())) == sorted(map(str, want.collect()))
