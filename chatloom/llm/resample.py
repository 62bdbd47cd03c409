"""Importance resampling: documents are drawn by how much their words look like a target's, with Gumbel noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import settle

#: A word is a run of characters other than these, A-Z in lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Inner points a counting job looks at: what four halvings in a row would ask.
POINTS = 15
#: The order of the draw, each a long and never null: score downwards, rows without an id last, then the id; rows that
#: agree so far go by their text, and equal rows by their number in the scored table.
ORDER = ["neg", "unnamed", "named", "tie", "no"]


def plain_words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def features(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, joined by one space."""
    runs = [words]
    for n in range(2, longest + 1):
        # shifted arrays side by side: an array is read once, not once per word
        left = F.greatest(F.size(words) - (n - 1), F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), left), F.slice(words, F.lit(n), left), lambda a, w: F.concat(a, F.lit(" "), w)))
    return F.concat(*runs) if longest > 1 else words


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> list[int]:
    """How many features of all texts fall into each bucket: added up before the shuffle, at most ``buckets`` rows come back."""
    each = texts.select(F.explode(features(plain_words(F.col("text")), longest)).alias("f"))
    counts = [0] * buckets
    for b, n in each.groupBy(bucket(F.col("f"), buckets).alias("b")).agg(F.count("*").alias("n")).collect():
        counts[b] = n
    return counts


def gains_of(docs: list[int], target: list[int]) -> list[int]:
    """Log ratio of the smoothed shares of a bucket in the target and in the documents, in thousandths."""
    s, t, k = sum(docs), sum(target), len(docs)
    return [math.floor(1000 * math.log(float(y + 1) * float(t_all) / (float(x + 1) * float(s_all))))
            for t_all, s_all in [(s + k, t + k)] for x, y in zip(docs, target)]


def scored(docs: DataFrame, target: DataFrame, longest: int, buckets: int, seed: int, carry: list[str]) -> DataFrame:
    """Per row its carried columns as ``row``, n_words, n_features, weight, score and the keys of ORDER; written to the shared folder."""
    gains = gains_of(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    # one literal array, looked up by bucket inside the row: no join, no shuffle
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    words = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("doc_id").alias("id"), "text",
                        plain_words(F.col("text")).alias("w"))
    f = words.select("row", "id", "text", F.size("w").cast("long").alias("n_words"), features(F.col("w"), longest).alias("f"))
    n = F.size("f").cast("long")
    total = F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + F.get(table, bucket(x, buckets)))
    weight = F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    d = f.select("row", "id", "n_words", n.alias("n_features"), weight.alias("weight"), noise.alias("noise"),
                 F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("no"))
    d = d.select("row", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"), "tie", "no",
                 (-(F.col("weight") + F.col("noise"))).alias("neg"), F.col("id").isNull().cast("long").alias("unnamed"),
                 F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long")).alias("named"))
    return settle(d, "scored")


def cutoff(rows: DataFrame, keys: list[str], k: int) -> list[tuple[str, int]]:
    """The threshold of the ``k`` first rows by ``keys`` (longs, never null), as (key, value) pairs: rows whose keys are at
    most these values, compared in order, are exactly ``k``. Expects 0 < k <= rows, and keys that tell rows apart.

    Key by key: the least value with enough rows at or below it is found by narrowing an interval with exact counts, then
    the search goes on among the rows that tie there. No row leaves its partition."""
    found, here, want = [], rows, k
    for key in keys:
        low, high, n = here.agg(F.min(key), F.max(key), F.count("*")).first()
        if found and n == want:
            break
        below, at_low, high = 0, low - 1, high      # rows at or below at_low
        while high - at_low > 1:
            gap = high - at_low
            points = sorted({at_low + gap * i // (POINTS + 1) for i in range(1, POINTS + 1)} - {at_low, high})
            counts = here.agg(*[F.count(F.when(F.col(key) <= F.lit(p).cast("long"), 1)).alias(f"c{i}") for i, p in enumerate(points)]).first()
            for p, c in zip(points, counts):
                if c >= want:
                    high = p
                    break
                at_low, below = p, c
        found.append((key, high))
        want -= below
        here = here.filter(F.col(key) == F.lit(high).cast("long"))
    return found


def within(found: list[tuple[str, int]]) -> Column:
    """Whether a row's keys are at most the threshold, compared in order."""
    inside = F.lit(True)
    for key, value in reversed(found):
        v = F.lit(value).cast("long")
        inside = (F.col(key) < v) | ((F.col(key) == v) & inside)
    return inside


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 1 by ``keys``: dealt out by range, counted per range, numbered inside each."""
    pieces = settle(rows.repartitionByRange(*keys).withColumn("piece", F.spark_partition_id()), "ranges")
    counts = sorted(tuple(r) for r in pieces.groupBy("piece").count().collect())    # a row per partition
    before, offsets = 0, []
    for piece, n in counts:
        offsets.append((piece, before))
        before += n
    starts = rows.sparkSession.createDataFrame(offsets, "piece int, before long")
    place = F.row_number().over(Window.partitionBy("piece").orderBy(*keys))
    return (pieces.withColumn("place", place).join(F.broadcast(starts), "piece")
            .withColumn("rank", F.col("before") + F.col("place")).drop("piece", "place", "before"))


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1,
                      buckets: int = 10000, seed: int = 2024, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, ...) as ``row`` (``carry``, all columns unless given) with n_features, weight, score and
    ``rank``: the floor(percent * N / 100) highest scores of the N rows with ``least_words`` words are drawn, the others have no rank.

    Counts cover all rows of ``docs`` and ``target``. Weights are looked up in an array of a number per bucket, the scores are written
    once, the cutoff is found by counting, and only drawn rows are dealt out by range for their ranks.

    Null and empty texts have no words, weight 0. A null id counts as the empty text in the noise and comes after all ids in ties. Rows
    that agree in score and id go by the hash of their text; rows that are equal are drawn one by one. An empty table gives no rows,
    an empty target only smoothing. Columns of ``docs`` stay inside ``row`` and clash with nothing."""
    rows = scored(docs, target, longest, buckets, seed, carry or docs.columns)
    enough = F.col("n_words") >= least_words
    k = percent * rows.filter(enough).count() // 100
    out = lambda d, rank: d.select("row", "n_features", "weight", "score", rank.cast("long").alias("rank"))
    if not k:
        return out(rows, F.lit(None))
    inside = enough & within(cutoff(rows.filter(enough), ORDER, k))
    drawn = ranked(rows.filter(inside), ORDER)
    return out(rows.filter(~inside), F.lit(None)).unionByName(out(drawn, F.col("rank")))
