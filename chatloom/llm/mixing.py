"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import n_words, settle, small_enough, uniform

#: Fixed by the contract: weights of the sources in code-point order, repeating; share of all words; most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents that one reduction step folds; documents above 1/8 and 1/64 of their source are rounded ahead of the rest.
FAN_IN, TIERS = 512, (8, 64)
NEAR = 1e-9


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: source_size, target. ``sized`` has source, size and the number ``n`` of such rows.

    Targets share ``share`` of all words by weight; what a source can't hold (``most`` times its size) is
    shared again by weight among the others. That settles at min(most * size, weight * level), and the level
    is the greatest of those that come from filling the 0, 1, 2, ... soonest full sources. One row per
    source passes the unpartitioned windows."""
    ranked = (sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
              .withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
              .withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("no", F.lit(len(weights))))))
    everything = Window.partitionBy()
    fuller = Window.orderBy((F.col("source_size") / F.col("weight")), "no")
    here = fuller.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = F.sum("source_size").over(here) - F.col("source_size")
    light = F.sum("weight").over(everything) - F.sum("weight").over(here) + F.col("weight")
    total = F.sum("source_size").over(everything)
    return (ranked.withColumn("level", (total * share - full * most) / light)
            .withColumn("level", F.max("level").over(everything))
            .select("source", "source_size",
                    F.least(F.col("source_size") * float(most), F.col("weight") * F.col("level")).alias("target")))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _snapped(f: Column) -> Column:
    return F.when(f < NEAR, 0.0).when(f > 1 - NEAR, 1.0).otherwise(f)


def _pair(a: Column, b: Column, level: int, seed: int) -> Column:
    """Move mass between two fractional documents until one is whole; words and expectations stay as they were."""
    up, down = F.least((1 - a["f"]) * a["size"], b["f"] * b["size"]), F.least(a["f"] * a["size"], (1 - b["f"]) * b["size"])
    dice = uniform(F.lit(seed), F.lit(level), a["doc_id"], a["size"], b["doc_id"], b["size"])
    moved = F.when(dice * (up + down) < down, up).otherwise(-down)
    return _let(moved, lambda m: F.struct(a.withField("f", _snapped(a["f"] + m / a["size"])).alias("a"),
                                          b.withField("f", _snapped(b["f"] - m / b["size"])).alias("b")))


def _fold(items: Column, kind: str, level: int, seed: int) -> Column:
    """One bucket: struct(carry: the document still fractional or null, done: the documents that became whole)."""
    whole = lambda x: (x["f"] == 0) | (x["f"] == 1)

    def step(acc, x):
        p = _pair(acc["carry"], x, level, seed)
        met = _let(p, lambda q: F.struct(
            F.when(~whole(q["a"]), q["a"]).when(~whole(q["b"]), q["b"]).alias("carry"),
            F.concat(acc["done"], F.filter(F.array(q["a"], q["b"]), whole)).alias("done")))
        return F.when(acc["carry"].isNull(), F.struct(x.alias("carry"), acc["done"].alias("done"))).otherwise(met)

    empty = F.struct(F.lit(None).cast(kind).alias("carry"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(items, empty, step)


def _round_all(items: DataFrame, seed: int, fan_in: int, label: str) -> DataFrame:
    """Every item with f in {0, 1}: a tree of folds per source, ``fan_in`` items a bucket, the last item by its odds.

    Items go to buckets by hash, so no bucket follows the size of a source."""
    kind = dict(items.dtypes)["item"]
    sources = items.groupBy("source").agg(F.count(F.lit(1)).alias("items"))
    most = sources.agg(F.max("items")).first()[0] or 0
    done, level = [], 0
    while most > 0:
        last = most <= fan_in
        if last:
            dealt = items.withColumn("bucket", F.lit(0).cast("long"))
        else:
            buckets = F.greatest(F.lit(1), F.ceil(F.col("items") / fan_in))
            sources = settle(items.groupBy("source").agg(F.count(F.lit(1)).alias("items")), "mix-sources")
            dealt = (items.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
                     .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + level), "item.doc_id", "item.size"), buckets)))
        folded = settle(dealt.groupBy("source", "bucket")
                        .agg(F.array_sort(F.collect_list(F.struct(F.col("item.size").alias("s"), F.col("item.doc_id").alias("d"), "item"))).alias("all"))
                        .select("source", _fold(F.transform("all", lambda x: x["item"]), kind, level, seed).alias("r")), f"mix-{label}")
        done.append(folded.select("source", F.explode("r.done").alias("item")))
        items = folded.filter(F.col("r.carry").isNotNull()).select("source", F.col("r.carry").alias("item"))
        most = 0 if last else items.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        level += 1
        if last:
            odds = uniform(F.lit(seed), F.lit(-1), F.col("item.doc_id"), F.col("item.size"))
            done.append(items.withColumn("item", F.col("item").withField("f", F.when(odds < F.col("item.f"), 1.0).otherwise(0.0))))
    out = done[0] if done else items.limit(0)
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7,
        fan_in: int = FAN_IN, tiers=TIERS) -> DataFrame:
    """``mix`` with the number ``no`` of a row among the ``n`` that agree in id, source and size."""
    sized = settle(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
                   .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    targets = settle(source_targets(sized, weights, share, most), "mix-targets")
    wanted = (sized.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
              .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
              .withColumn("whole", F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("rate") + NEAR)))
              .withColumn("mass", F.when(F.col("size") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")) * F.col("n")))
              .withColumn("extra", F.floor(F.col("mass") + NEAR))
              .withColumn("f", _snapped(F.greatest(F.lit(0.0), F.col("mass") - F.col("extra")))))
    item = F.struct("doc_id", "size", "n", "source_size", "target", "whole", "extra", F.col("f").alias("f"), F.col("f").alias("f0"))
    items = wanted.select("source", item.alias("item"))
    open_ = settle(items.filter("item.f > 0"), "mix-open")
    settled = items.filter("item.f = 0").select("source", "item")
    for no, part in enumerate([*tiers, None]):
        now = F.lit(True) if part is None else F.col("item.size") * part > F.col("item.source_size")
        tier = open_.filter(now).select("source", "item")
        rounded = _round_all(tier.filter("item.f > 0 and item.f < 1"), seed + no, fan_in, f"tier{no}")
        rounded = rounded.unionByName(tier.filter("item.f = 0 or item.f = 1"))
        if part is None:
            settled = settled.unionByName(rounded)
            break
        rounded = settle(rounded, "mix-tier")
        settled = settled.unionByName(rounded)
        missed = rounded.groupBy("source").agg(F.sum(F.col("item.size") * (F.col("item.f") - F.col("item.f0"))).alias("over"))
        rest = open_.filter(~now)
        # what the tier took too much or too little, the smaller documents make up for
        factor = settle(rest.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("item.size") * F.col("item.f0")).alias("room"))
                        .join(missed, F.col("_s").eqNullSafe(F.col("source")), "left")
                        .select("_s", F.coalesce("over", F.lit(0.0)).alias("over"), (1 - F.coalesce("over", F.lit(0.0)) / F.col("room")).alias("factor")), "mix-factor")
        share_ = _snapped(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("item.f") * F.col("factor"))))
        open_ = settle(rest.join(factor, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", F.col("item").withField("f", share_).withField("f0", F.col("item.f") * F.col("factor")).alias("item")), "mix-rest")
    one = settled.select("source", "item.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("item.n"))).alias("no"))
    copies = F.col("whole") + F.when(F.col("no") <= F.col("extra") + F.col("f"), 1).otherwise(0)
    return one.select("doc_id", "source", "size", "n", "no", "source_size", "target", copies.cast("long").alias("copies"),
                      (copies * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken.

    Every document of a source is wanted target / source_size times. The whole part is granted; the fraction is
    settled by pivotal rounding: two fractional documents exchange words at random until one is whole, whose
    expectations and word total stay as they were, so a source misses its target only by its last document. Documents
    above 1/8, then above 1/64 of their source (fewer than 8 and 64 a source) are rounded first and smaller ones make
    up for what those took too much or too little; the last document is then a small one.

    Null or empty text: size 0, never taken. A null source is a source like others, last in order. Rows that agree
    in id, source and size share their copies out; the first get one more. No rows give no rows. Other columns are
    ignored. Randomness is a hash of ids: reruns agree. Groups are buckets of a tree, never a source."""
    return _mixed(docs, **settings).drop("n", "no")


def mixed_corpus(docs: DataFrame, in_memory: int = 500_000, **settings) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with copies, size, source_size, target and taken (columns of these names give way).

    Up to ``in_memory`` decisions are broadcast, more are joined by a shuffle. Rows that agree in id, source and size are numbered
    to share their copies out; only those are shuffled with their texts for it."""
    own = ["copies", "size", "source_size", "target", "taken"]
    keys = ["doc_id", "source", "size"]
    said = settle(_mixed(docs, **settings).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias("_n"), F.col("no").alias("_no"), F.struct(*own).alias("_mix")), "mixed")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own]).alias("row"))
    d = d.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = d.join(small_enough(said.filter("_n = 1 and _mix.copies > 0"), in_memory), same).select("row", "_mix")
    repeated = said.filter("_n > 1 and _mix.copies > 0")
    if not repeated.isEmpty():
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("row.text"))
        several = d.join(small_enough(repeated.select(*[f"_{k}" for k in keys]).distinct(), in_memory), same, "left_semi").withColumn("no", F.row_number().over(order))
        out = out.unionByName(several.join(repeated, same & (F.col("no") == F.col("_no"))).select("row", "_mix"))
    return out.select("row.*", "_mix.*")
