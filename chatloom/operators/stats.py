"""Message statistics. ``by`` names the report (or other grouping) the figures belong to; without it they
cover the whole table. Everything here is a partial aggregation followed by one small shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import is_ui_noise
from .scan import number_by_ranges


def top_k(counts: DataFrame, by: list[str], k: int, n: str, term: str) -> DataFrame:
    """The ``k`` largest rows per ``by``, ties in term order, with a 1-based ``rank``. Without ``by`` this
    plans as TakeOrderedAndProject; with it, ranks are limited before the shuffle."""
    order = [F.col(n).desc(), F.col(term).asc()]
    if not by:
        counts = counts.orderBy(*order).limit(k)   # the single-partition window below sees k rows
    w = Window.partitionBy(*by).orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def count_by_kind(messages: DataFrame, by: list[str] = []) -> DataFrame:
    return messages.groupBy(*by, "kind").agg(F.count("*").alias("n"))


def count_by_chat(chats: DataFrame, messages: DataFrame, chat: str = "chat") -> DataFrame:
    """Messages per chat, empty chats included. Counts shrink to a row per chat before the join."""
    n = messages.groupBy(chat).agg(F.count("*").alias("n"))
    return chats.select(chat).join(n, chat, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def time_span(messages: DataFrame, by: list[str] = []) -> DataFrame:
    return messages.groupBy(*by).agg(F.min("ts").alias("time_start"), F.max("ts").alias("time_end"))


def _who() -> Column:
    return F.coalesce(F.nullif(F.col("speaker"), F.lit("")),
                      F.when(F.col("side") == "right", F.lit(K.SELF)).otherwise(F.lit(K.OTHER)))


def speaker_counts(messages: DataFrame, by: list[str] = []) -> DataFrame:
    return (messages.filter(F.col("kind").isin("text", "voice", "image"))
            .groupBy(*by, _who().alias("who")).agg(F.count("*").alias("n")))


def top_speakers(messages: DataFrame, k: int = 10, by: list[str] = []) -> DataFrame:
    return top_k(speaker_counts(messages, by), by, k, "n", "who")


def by_day(messages: DataFrame, by: list[str] = []) -> DataFrame:
    return (messages.filter(F.col("ts").isNotNull())
            .groupBy(*by, F.to_date("ts").alias("day")).agg(F.count("*").alias("n")))


def active_days(messages: DataFrame, by: list[str] = []) -> DataFrame:
    # day counts first: a distinct count over rows would shuffle every distinct (by, day) per task anyway
    return by_day(messages, by).groupBy(*by).agg(F.count("*").alias("active_days"))


def peak_day(messages: DataFrame, by: list[str] = []) -> DataFrame:
    """The busiest day; the earlier one on a tie."""
    best = F.max(F.struct(F.col("n"), (-F.unix_date("day")).alias("r"), F.col("day")))
    return (by_day(messages, by).groupBy(*by).agg(best.alias("b"))
            .select(*by, F.col("b.day").alias("day"), F.col("b.n").alias("n")).filter("day is not null"))


def by_hour(messages: DataFrame, by: list[str] = []) -> DataFrame:
    return (messages.filter(F.col("ts").isNotNull())
            .groupBy(*by, F.hour("ts").alias("hour")).agg(F.count("*").alias("n")))


def keyword_terms(text: Column, parity: bool = False) -> Column:
    """CJK character pairs without stop words, and (unless ``parity``) lower-case words of three or more
    characters that start with a letter."""
    stop = [w for w in K.STOP_WORDS]
    singles = [w for w in stop if len(w) == 1]
    runs = F.regexp_extract_all(text, F.lit("[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    allowed = F.filter(pairs, lambda p: ~F.substring(p, 1, 1).isin(singles) & ~F.substring(p, 2, 1).isin(singles)
                       & (F.lit(parity) | ~p.isin(stop)))
    if parity:
        return allowed
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), F.lower)
    return F.concat(allowed, words)


def keyword_counts(messages: DataFrame, by: list[str] = [], parity: bool = False) -> DataFrame:
    terms = F.explode(keyword_terms(F.coalesce("text", F.lit("")), parity)).alias("term")
    return (messages.filter(F.col("kind") == "text").select(*by, terms)
            .groupBy(*by, "term").agg(F.count("*").alias("n")))


def keywords(messages: DataFrame, k: int = 15, min_n: int = 3, by: list[str] = [], parity: bool = False) -> DataFrame:
    counts = keyword_counts(messages, by, parity).filter(F.col("n") >= min_n)
    return top_k(counts, by, k, "n", "term")


def stats_cube(messages: DataFrame) -> DataFrame:
    """Counts by kind, chat, day, hour and overall from one scan. ``level`` says which."""
    m = messages.select("kind", "chat", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
    sets = [[F.col("kind")], [F.col("chat")], [F.col("day")], [F.col("hour")], []]
    level = F.grouping_id("kind", "chat", "day", "hour")
    named = (F.when(level == 7, "kind").when(level == 11, "chat").when(level == 13, "day")
             .when(level == 14, "hour").otherwise("all"))
    g = m.groupingSets(sets, "kind", "chat", "day", "hour").agg(F.count("*").alias("n"), named.alias("level"))
    # rows without a time have no day and no hour
    return g.filter(~((F.col("level") == "day") & F.col("day").isNull())
                    & ~((F.col("level") == "hour") & F.col("hour").isNull()))


def coverage(messages: DataFrame, chat: str = "chat") -> DataFrame:
    """First and last day per chat, before any window is applied; '' where no message has a time."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return messages.groupBy(chat).agg(
        F.coalesce(F.concat(day(F.min("ts")), F.lit(" ~ "), day(F.max("ts"))), F.lit("")).alias("coverage"))


def transcript_header(messages: DataFrame, chat: str = "chat") -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    kind = F.col("kind")
    return messages.groupBy(chat).agg(
        F.count_if((kind == "text") & ~is_ui_noise("text")).alias("n_text"),
        F.count_if(kind == "image").alias("n_image"),
        F.count_if(kind == "voice").alias("n_voice"),
        F.coalesce(F.concat(day(F.min("ts")), F.lit(" ~ "), day(F.max("ts"))),
                   F.lit("（无时间标签）")).alias("span"))


def stats_brief(messages: DataFrame, by: list[str], parity: bool = False, speakers: int = 8, chats: DataFrame | None = None,
                name_chats: bool = True) -> DataFrame:
    """A readable digest per report. Lines without data are left out.

    Two scans: one aggregation by chat, speaker, day and report at once, and the keywords. ``chats`` (by, chat) brings chats that have
    no messages. The chats of a report are the only list without a fixed length; for reports over very many chats turn
    ``name_chats`` off and take them as rows from ``count_by_chat``.
    """
    who = F.when(F.col("kind").isin("text", "voice", "image"), _who())
    rows = messages.select(*by, "chat", "kind", "ts", F.to_date("ts").alias("day"), who.alias("who"), F.lit(1).alias("one"))
    if chats is not None:
        rows = rows.unionByName(chats.select(*by, "chat", F.lit(0).alias("one")), allowMissingColumns=True)
    dims = ["chat", "who", "day"]
    of_chat, of_who, of_day, of_all, of_word = 3, 5, 6, 7, 8
    level = F.grouping_id(*by, *dims)
    cube = rows.groupingSets([[F.col(c) for c in (*by, *d)] for d in (["chat"], ["who"], ["day"], [])], *by, *dims).agg(
        level.cast("int").alias("level"), F.sum("one").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("text", "image", "voice")])
    # only speakers are ranked; the other rows of a report are spread
    apart = F.when(F.col("level") == of_who, F.lit(-1)).otherwise(F.pmod(F.hash("chat", "day"), F.lit(64)))
    order = Window.partitionBy(*by, "level", apart).orderBy(F.desc("n"), "who")
    ranked = cube.filter((F.col("level") != of_who) | F.col("who").isNotNull()).withColumn("rank", F.row_number().over(order))
    ranked = ranked.filter((F.col("level") != of_who) | (F.col("rank") <= speakers))
    words = keywords(messages, by=by, parity=parity).select(*by, F.lit(of_word).alias("level"), "rank", "term")
    at = lambda lv, *fields: F.when(F.col("level") == lv, F.struct(*fields))
    dated = (F.col("level") == of_day) & F.col("day").isNotNull()
    per = ranked.unionByName(words, allowMissingColumns=True).groupBy(*by).agg(
        F.max(at(of_all, "n", "text", "image", "voice", "start", "end")).alias("all"), F.count_if(dated).alias("days"),
        F.max(F.when(dated, F.struct(F.col("n"), (-F.unix_date("day")).alias("r"), F.col("day")))).alias("peak"),
        *[F.array_sort(F.collect_list(at(lv, *fields))).alias(name) for name, lv, fields in (
            ("chats", of_chat if name_chats else -1, ("chat", "n")), ("people", of_who, ("rank", "who", "n")), ("words", of_word, ("rank", "term")))])
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    joined = lambda c, text, sep: F.array_join(F.transform(c, text), sep)
    counted = lambda name: lambda x: F.format_string("%s %d 条", x[name].cast("string"), x["n"])
    lines = [
        F.when(F.col("days") > 0, F.format_string("时间范围：%s ~ %s（活跃 %d 天）", day("all.start"), day("all.end"), "days")),
        F.format_string("消息总量：%d 条（文字 %d / 图片 %d / 语音 %d）", "all.n", "all.text", "all.image", "all.voice"),
        F.when(F.size("chats") > 1, F.concat(F.lit("各聊天分布："), joined("chats", counted("chat"), "，"))),
        F.when(F.size("people") > 0, F.concat(F.lit("活跃参与者："), joined("people", counted("who"), "，"))),
        F.when(F.col("peak").isNotNull(), F.format_string("消息峰值日：%s（%d 条）", F.col("peak.day").cast("string"), F.col("peak.n"))),
        F.when(F.size("words") > 0, F.concat(F.lit("高频关键词："), joined("words", lambda x: x["term"], "、")))]
    return per.select(*by, F.concat_ws("\n", *lines).alias("brief"))


def report_overview(messages: DataFrame, by: list[str] = []) -> DataFrame:
    """The six headline figures as (no, metric, value) rows."""
    kinds = ("text", "image", "voice")
    agg = messages.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    best = F.max(F.struct(F.col("n"), (-F.unix_date("day")).alias("r"), F.col("day")))
    d = by_day(messages, by).groupBy(*by).agg(F.count("*").alias("active"), best.alias("b"))
    # one row per report on either side: stacked and folded, which needs no join
    both = agg.unionByName(d, allowMissingColumns=True).groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("n", *kinds, "active", "b")])
    rows = [("消息总量", F.format_string("%d 条", "n")), ("文字消息", F.format_string("%d 条", "text")),
            ("图片消息", F.format_string("%d 条", "image")), ("语音消息", F.format_string("%d 条", "voice")),
            ("活跃天数", F.format_string("%d 天", F.coalesce("active", F.lit(0)))),
            ("消息峰值日", F.coalesce(
                F.when(F.col("b").isNotNull() & F.col("b.day").isNotNull(),
                       F.format_string("%s（%d 条）", F.col("b.day").cast("string"), "b.n")), F.lit("—")))]
    table = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(m).alias("metric"), v.alias("value"))
                      for i, (m, v) in enumerate(rows, 1)])
    return both.select(*by, F.inline(table))


def model_usage(calls: DataFrame) -> DataFrame:
    """Calls per model and the rough token estimate (characters / 1.6, rounded down)."""
    chars = F.sum("prompt_chars") + F.sum("completion_chars")
    return calls.groupBy("model").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"),
        F.floor(chars / F.lit(1.6)).cast("long").alias("est_tokens"))


def numbered_rows(rows: DataFrame, by: list[str], order: list[Column], name: str = "no") -> DataFrame:
    """1-based index of table rows, per report. A report may hold most rows; ``order`` must tell its rows apart."""
    return number_by_ranges(rows, by, order, name)
