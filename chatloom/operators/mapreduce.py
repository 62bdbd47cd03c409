"""Chunked extraction: lines to chunks, chunks to points, points to report input."""

from __future__ import annotations

from typing import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.constants import CATEGORIES
from ..functions.lines import parse_json_loose
from ..functions.text import character_key
from ..session import settle
from .scan import ROWS_PER_SLICE, carry_scan, fold_sorted, key_ddl, null_safe_join, number_rows, slice_of


class _SliceChunks:
    """What a slice of lines does to the fill of the chunk it receives.

    With a fill of ``s`` the first chunk closes at the first line where ``s`` plus the running length
    reaches the limit; from there on nothing depends on ``s``. So the slice is described by the few
    lines at which a received chunk can close: (least fill, chunks closed, fill left).
    """

    def __init__(self, limit):
        self.limit, self.lengths = limit, []

    def run(self, columns):
        self.lengths.append(columns[1])

    def end(self):
        import numpy as np

        total = np.cumsum(np.concatenate(self.lengths))
        n, whole = len(total), int(total[-1]) if len(total) else 0
        known = {}

        def fresh(i):
            """Chunks closed and fill left when a chunk starts at line ``i``."""
            path = []
            while i not in known:
                base = int(total[i - 1]) if i else 0
                j = int(np.searchsorted(total, base + self.limit)) if i < n else n
                if j >= n:
                    known[i] = (0, whole - base)
                    break
                path.append(i)
                i = j + 1
            closed, left = known[i]
            for k in reversed(path):
                closed += 1
                known[k] = (closed, left)
            return known[path[0]] if path else (closed, left)

        cases, j, prev = [], 0, 0
        while j < n and prev < self.limit:
            if total[j] > prev:     # an empty line cannot be the one that closes
                closed, left = fresh(j + 1)
                cases.append([int(max(0, self.limit - total[j])), closed + 1, left])
                prev = int(total[j])
            j += 1
        return [(whole, cases)]


class _ChunkCarry:
    """Walks slice summaries: fill and chunk number each slice receives."""

    def __init__(self):
        self.fill, self.no = 0, 0

    def row(self, values):
        piece, whole, cases = values
        out = [(piece, self.fill, self.no)]
        for least, closed, left in cases:      # least fill falls from case to case
            if self.fill >= least:
                self.no += int(closed)
                self.fill = int(left)
                break
        else:
            self.fill += int(whole)
        return out

    def end(self):
        return ()


class _ChunkNumbers:
    """Numbers the lines of a slice, one search per chunk."""

    def __init__(self, limit):
        self.limit, self.fill = limit, None

    def run(self, columns):
        import numpy as np

        seq, lengths, fill, no = columns
        if self.fill is None:
            self.fill, self.no = int(fill[0]), int(no[0])
        total, numbers, i = np.cumsum(lengths), np.empty(len(seq), dtype="int64"), 0
        while i < len(seq):
            base = int(total[i - 1]) if i else 0
            j = int(np.searchsorted(total, self.limit - self.fill + base))
            numbers[i:j + 1] = self.no
            if j >= len(seq):
                self.fill += int(total[-1]) - base
                break
            self.fill, self.no, i = 0, self.no + 1, j + 1
        return [seq, numbers]

    def end(self):
        return ()


def number_chunks(lines: DataFrame, keys: list[str], chars: int = K.CHUNK_CHARS, seq: str = "seq",
                  line: str = "line", width: int = ROWS_PER_SLICE) -> DataFrame:
    """``chunk_no`` of each line: a chunk closes with the line that brings it to ``chars`` characters
    (line breaks not counted) and the next one starts empty.

    The restart makes this a fold. It runs per slice of lines; slice summaries are walked per chat to tell
    each slice what it receives. Only positions and lengths go through Python; the text is joined back
    on (keys, seq), which no single chat can skew.
    """
    ddl, sliced = key_ddl(lines, keys), [*keys, "_slice"]
    size = lines.select(*keys, slice_of(seq, width).alias("_slice"), F.col(seq).cast("long").alias(seq),
                        F.length(line).cast("long").alias("_len"))
    parts = fold_sorted(size, sliced, [seq], lambda: _SliceChunks(chars),
                        f"{ddl}, _slice bigint, whole bigint, cases array<array<bigint>>")
    carry = fold_sorted(parts, keys, ["_slice"], _ChunkCarry, f"{ddl}, _slice bigint, fill bigint, no bigint")
    ready = null_safe_join(size, carry, sliced, "left").select(*sliced, seq, "_len", "fill", "no")
    numbered = fold_sorted(ready, sliced, [seq], lambda: _ChunkNumbers(chars),
                           f"{ddl}, _slice bigint, {seq} bigint, chunk_no bigint")
    return null_safe_join(lines, numbered.drop("_slice"), [*keys, seq])


def chunk_lines(lines: DataFrame, keys: list[str], chars: int = K.CHUNK_CHARS, seq: str = "seq",
                line: str = "line", width: int = ROWS_PER_SLICE) -> DataFrame:
    """Chunk texts per chat, numbered from 0. A chunk holds at most ``chars`` characters before its last
    line, so collecting one is safe."""
    n = number_chunks(lines, keys, chars, seq, line, width)
    parts = F.array_sort(F.collect_list(F.struct(seq, line)))
    return n.groupBy(*keys, "chunk_no").agg(
        F.array_join(F.transform(parts, lambda x: x[line]), "\n").alias("text"),
        F.count("*").alias("n_lines"), F.sum(F.length(line)).alias("n_chars"))


def cap_chunks(chunks: DataFrame, n: int = K.MAX_CHUNKS) -> DataFrame:
    """The first ``n`` chunks of each report (a cost limit of the extraction)."""
    return chunks.filter(F.col("chunk_no") < n)


POINT = "struct<date: string, desc: string, by: string, owner: string, due: string, who: string, point: string>"


def extract_by_rules(chunk: str) -> str:
    """A deterministic stand-in for a model: dated lines are events, questions are problems and other lines
    with a number are facts. Answers as models do, with JSON in a code fence."""
    import json
    import re

    out = {c: [] for c in CATEGORIES}
    for line in chunk.split("\n"):
        date = re.search(r"\d{4}-\d{2}-\d{2}", line)
        if date:
            out["events"].append({"date": date[0], "desc": line})
        elif line.rstrip().endswith(("?", "？")):
            out["problems"].append({"desc": line})
        elif re.search(r"[0-9]", line):
            out["facts"].append({"desc": line})
    return "```json\n" + json.dumps(out, ensure_ascii=False) + "\n```"


def one_by_one(fn: Callable[[str], str]) -> Callable[[Iterator], Iterator]:
    """A function of one text as a function over an iterator of frames (column ``text``) that yields replies."""
    def run(frames: Iterator) -> Iterator:
        for f in frames:
            yield [fn(t) for t in f["text"]]
    return run


def _called(texts: DataFrame, cols: list[str], frames: Callable[[Iterator], Iterator], parallelism: int | None) -> DataFrame:
    """``texts`` (cols, text) with the reply of each. ``frames`` gets the frames of a task one after the other and yields as many replies
    for each, so that it can load a model once a task and send a frame at a time."""
    def run(batches: Iterator):
        kept = []

        def passed():
            for pdf in batches:
                if len(pdf):
                    kept.append(pdf[cols])
                    yield pdf[["text"]]

        for replies in frames(passed()):
            keys = kept.pop(0)
            replies = list(replies)
            if len(replies) != len(keys):
                raise ValueError(f"{len(keys)} chunks, {len(replies)} replies")
            yield keys.assign(reply=replies)
        if kept:
            raise ValueError("the model function ended before its input")

    source = texts.select(*cols, "text")
    if parallelism:
        source = source.repartition(parallelism)
    return source.mapInPandas(run, f"{key_ddl(texts, cols)}, reply string")


def stored_replies(spark: SparkSession, store: str) -> DataFrame:
    """What a reply store holds, one reply per chunk hash; nothing if the store is not there yet."""
    try:
        known = spark.read.schema("chunk_hash string, reply string").parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "chunk_hash string, reply string")
    return known.groupBy("chunk_hash").agg(F.min("reply").alias("reply"))


def ask_missing(chunks: DataFrame, store: str, frames: Callable[[Iterator], Iterator], version: str = "", commits: int = 1,
                parallelism: int | None = None) -> DataFrame:
    """``chunks`` with ``reply``, calling the model only for texts that the store has no reply for. Equal chunks are asked once.

    Replies are filed under a hash of ``version`` (model and prompt) and text. They are written in ``commits`` parts, so a run that
    ends early loses at most the part it was in."""
    spark = chunks.sparkSession
    hashed = chunks.withColumn("chunk_hash", F.sha2(F.concat(F.lit(f"{version}\n"), F.coalesce("text", F.lit(""))), 256))
    missing = (hashed.select("chunk_hash", "text").dropDuplicates(["chunk_hash"])
               .join(stored_replies(spark, store), "chunk_hash", "left_anti"))
    missing = settle(missing, "missing")
    for i in range(commits):
        part = missing.filter(F.pmod(F.xxhash64("chunk_hash"), F.lit(commits)) == i) if commits > 1 else missing
        if not part.isEmpty():
            _called(part, ["chunk_hash"], frames, parallelism).write.mode("append").parquet(store)
    return hashed.join(stored_replies(spark, store), "chunk_hash").drop("chunk_hash")


def map_chunks(chunks: DataFrame, keys: list[str], fn: Callable[[str], str] = extract_by_rules,
               parallelism: int | None = None, frames: Callable[[Iterator], Iterator] | None = None, store: str | None = None,
               version: str = "", commits: int = 1) -> DataFrame:
    """Ask a model about every chunk and read the replies. Rows: (keys, chunk_no, reply, value variant, raw).

    The model is ``fn`` (text to reply) or ``frames``, which takes an iterator of frames with a column ``text`` and yields their replies,
    frame by frame. It runs on executors. With ``store``, a folder, replies are kept and a rerun asks only what is not answered
    yet (see ``ask_missing``)."""
    cols = [*keys, "chunk_no"]
    run = frames or one_by_one(fn)
    if store:
        replies = ask_missing(chunks.select(*cols, "text"), store, run, version, commits, parallelism).select(*cols, "reply")
    else:
        replies = _called(chunks, cols, run, parallelism)
    return (replies.withColumn("_j", parse_json_loose("reply"))
            .withColumn("value", F.col("_j.value")).withColumn("raw", F.col("_j.raw")).drop("_j"))


def points_of(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of the replies that could be read: one row per point, in reply order."""
    good = mapped.filter(F.col("raw").isNull())
    # the categories as one array: a union of six branches would call the model six times a chunk
    fields = F.array(*[F.struct(F.lit(no).alias("category_no"), F.lit(c).alias("category"),
                                F.try_variant_get("value", f"$.{c}", f"array<{POINT}>").alias("items"))
                       for no, c in enumerate(CATEGORIES)])
    each = good.select(*keys, "chunk_no", F.explode(fields).alias("f"))
    return (each.select(*keys, "chunk_no", "f.category_no", "f.category", F.posexplode("f.items").alias("pos", "p"))
            .select(*keys, "chunk_no", "category_no", "category", "pos", "p.*"))


def merge_points(points: DataFrame, keys: list[str], order: list[str] = ["chunk_no", "pos"],
                 exact: bool = False, key_chars: int | None = None) -> DataFrame:
    """Keep the first point per category and key. The key is the sorted set of characters (so anagrams
    meet), its first ``key_chars`` if that is given, or with ``exact`` the text itself. Points that say the
    same collapse inside each task."""
    text = F.coalesce(F.col("desc"), F.concat_ws("：", "who", "point")) if "point" in points.columns else F.col("desc")
    rest = [c for c in points.columns if c not in (*keys, "category")]
    keyed = points.withColumn("_key", text if exact else character_key(text, key_chars))
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return (keyed.groupBy(*keys, "category", "_key").agg(first.alias("r"))
            .select(*keys, "category", *[F.col(f"r.{c}").alias(c) for c in rest], F.col("_key").alias("merge_key")))


def reduce_points(points: DataFrame, keys: list[str], order: list[str] = ["chunk_no", "pos"]) -> DataFrame:
    """Distinct points per category."""
    return merge_points(points, keys, order).groupBy(*keys, "category").agg(F.count("*").alias("n"))


def points_json(merged: DataFrame, keys: list[str], order: list[str] = ["chunk_no", "pos"],
                chars: int = K.POINT_CHARS) -> DataFrame:
    """The merged points of a report as one JSON text, cut at ``chars``.

    Only text that can fall inside the cut is collected: an entry takes at least four characters, so
    ``chars / 4`` entries per category are enough to fill it.
    """
    w = Window.partitionBy(*keys, "category").orderBy(*order)
    near = merged.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= chars // 4)
    fields = [c for c in ("date", "desc", "by", "owner", "due", "who", "point") if c in merged.columns]
    entry = F.struct(F.col("_r"), F.to_json(F.struct(*fields)).alias("j"))
    per = near.groupBy(*keys, "category").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["j"]), ", ").alias("j"))
    wide = per.groupBy(*keys).agg(*[F.max(F.when(F.col("category") == c, F.col("j"))).alias(c) for c in CATEGORIES])
    parts = [F.concat(F.lit(f'"{c}": ['), F.coalesce(c, F.lit("")), F.lit("]")) for c in CATEGORIES]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return wide.select(*keys, F.substring(text, 1, chars).alias("points"))


def points_pages(merged: DataFrame, keys: list[str], order: list[str] = ["chunk_no", "pos"],
                 chars: int = K.POINT_CHARS, width: int = 1024) -> DataFrame:
    """The merged points of a report as JSON texts, numbered pages from 0: whole entries, none lost, each page readable by
    itself. A page has at most ``chars`` characters unless one entry alone takes more.

    Entries fall to half pages by where they start in the report; one longer than half a page gets its own. The
    running length is a carry scan by category and ``width`` values of the first column of ``order`` (a number), so no report or
    category is walked in one task."""
    fields = [c for c in ("date", "desc", "by", "owner", "due", "who", "point") if c in merged.columns]
    numbers = F.create_map(*[F.lit(x) for no, c in enumerate(CATEGORIES) for x in (c, no)])
    half = max(1, (chars - 2 - sum(len(c) + 8 for c in CATEGORIES)) // 2)
    entries = (merged.filter(F.col("category").isin(list(CATEGORIES))).withColumn("_c", numbers[F.col("category")])
               .select(*keys, "category", "_c", *order, F.to_json(F.struct(*fields)).alias("_j")).withColumn("_len", (F.length("_j") + 2).cast("long")))
    placed = carry_scan(entries, keys, F.struct("_c", slice_of(order[0], width).alias("at")), [F.col("_c"), *[F.col(c) for c in order]], total={"_end": F.col("_len")})
    start = F.col("_end") - F.col("_len")
    placed = placed.withColumn("_page", F.struct(F.floor(start / half).alias("half"), F.when(F.col("_len") > half, start + 1).otherwise(0).alias("alone")))
    one = F.struct(*order, F.col("_j").alias("j"))
    per = placed.groupBy(*keys, "_page", "_c", "category").agg(F.concat(
        F.lit('"'), F.col("category"), F.lit('": ['), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]), ", "), F.lit("]")).alias("_t"))
    pages = per.groupBy(*keys, "_page").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_t"))), lambda x: x["_t"]), ", "), F.lit("}")).alias("points"))
    counted = number_rows(pages.withColumn("_half", F.col("_page.half")), keys, slice_of("_half", 4096), [F.col("_page")], "page")
    return counted.select(*keys, (F.col("page") - 1).alias("page"), "points")


def reduce_input(chats: DataFrame, brief: DataFrame, points: DataFrame, keys: list[str], template: str = "work",
                 captions: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """The documents a final synthesis reads, one per report and page of points: type, all chat names, digest, captions
    and points. ``chats`` has (keys, chat) rows for the chats a report names, ``points`` the pages of ``points_pages``; a report
    without points has one document, page 0. Every page repeats what stands before the points.

    ``parity=True`` gives the cut form: one document per report, 80 characters of names and the text of ``points_json``."""
    each = chats.select(*keys, "chat").distinct()
    named = each
    if parity:
        # eighty names always fill eighty characters; the count covers them all
        named = each.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("chat"))).filter("_r <= 80")
    shown = named.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("chat", F.col("chat").cast("string").alias("c")))), lambda x: x["c"]), "、").alias("_names"))
    head = each.groupBy(*keys).agg(F.count("*").alias("_chats")).join(shown, keys)
    out = head.join(brief, keys, "left").join(points, keys, "left")
    if captions is not None:
        c = captions.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("image_no", "caption"))), lambda x: F.concat(F.lit("- "), x["caption"])), "\n").alias("_captions"))
        out = out.join(c, keys, "left")
    else:
        out = out.withColumn("_captions", F.lit(None).cast("string"))
    doc = F.concat_ws(
        "\n\n", F.lit(f"报告类型要求：{K.TEMPLATE_HINT[template]}"),
        F.concat(F.lit("数据来源："), F.col("_chats").cast("string"), F.lit(" 个聊天（"),
                 F.substring("_names", 1, 80) if parity else F.col("_names"), F.lit("）")),
        F.concat(F.lit("统计数据摘要：\n"), F.col("brief")), F.concat(F.lit("聊天图片内容：\n"), F.col("_captions")),
        F.concat(F.lit("分块提取的要点（JSON）：\n"), F.col("points")))
    page = [] if parity else [F.coalesce("page", F.lit(0)).cast("long").alias("page")]
    return out.select(*keys, *page, doc.alias("document"))


def timeline(points: DataFrame, keys: list[str], cap: int = K.TIMELINE_ROWS, order: list[str] = ["chunk_no", "pos"]) -> DataFrame:
    """Dated points in date order, at most ``cap`` per report, with a month heading where the month changes.
    The rank limit applies before the shuffle."""
    w = Window.partitionBy(*keys).orderBy("date", *order)
    top = (points.filter(F.coalesce("date", F.lit("")) != "").withColumn("no", F.row_number().over(w))
           .filter(F.col("no") <= cap))
    month = F.substring("date", 1, 7)
    changed = F.coalesce(F.lag(month).over(Window.partitionBy(*keys).orderBy("no")) != month, F.lit(True))
    heading = F.when(F.col("date").contains("-"),
                     F.concat(F.replace(month, F.lit("-"), F.lit(" 年 ")), F.lit(" 月"))).otherwise(F.col("date"))
    return top.select(*keys, "no", "date", "desc", F.when(changed, heading).alias("month_heading"))
