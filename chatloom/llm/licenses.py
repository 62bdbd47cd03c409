"""License scans by diagonal voting: rolling k-grams of all texts meet template positions, offsets vote."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import packed, settle, small_enough, text_key

#: Fixed by the contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening notices of public licenses, fixed values: label and text.
TEMPLATES = {
    "apache": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache-notice": "licensed under the apache license version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc0": "the person who associated a work with this deed has dedicated the work to the public domain",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Words of a k-gram; offsets that still belong together; share of a template's grams that a span must hold.
K, DRIFT, SHARE = 2, 3, 0.6
#: Texts with findings up to which these are broadcast to the rows; more are joined by a shuffle.
SMALL = 200_000
#: A word is a run of characters other than these.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """A-Z in lower case, nothing else touched, cut into words; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def _parts(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text) if w]


def _template_table(spark) -> DataFrame:
    """(g, template, tpos, bit): every k-gram of the templates and phrases, at most 63 of one template."""
    rows = [(name, i, 1 << i, w[i:i + K]) for name, text in {**TEMPLATES, **{p: p for p in PHRASES}}.items()
            for w in [_parts(text)] for i in range(len(w) - K + 1)]
    d = spark.createDataFrame(rows, "template string, tpos int, bit long, w array<string>")
    return d.select(F.xxhash64(*[F.get("w", F.lit(j)) for j in range(K)]).alias("g"), "template", "tpos", "bit")


def scan(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` (doc_id, text, ...) as ``row`` with n_words, ``places`` and ``spans``.

    Every rolling k-gram of every text joins the template positions it equals. Votes are counted per text, template
    and offset (a diagonal); grams of a template are bits, so a gram counts once however often its row comes.
    A phrase stands where one diagonal has all its grams: places, array of (start, label). For longer templates
    diagonals at most DRIFT apart are merged, as words may be missing or added, and the merged span is verified: it holds at
    least ``share`` of the template's grams and is at most half as long again: spans, array of (start, stop, label, share). Where stray
    grams chain diagonals into a longer run, its peaks count, each with the diagonals at most DRIFT to either side.
    Null text has no words. Equal rows get equal findings. The table of grams is a constant, hence the broadcast."""
    spark = docs.sparkSession
    grams = {n: len(_parts(t)) - K + 1 for n, t in TEMPLATES.items()}
    d = packed(docs).withColumn("_w", license_words(F.col("row.text")))
    d = d.select("row", "_w", F.size("_w").cast("long").alias("n_words"), text_key(F.col("row.doc_id"), F.col("row.text")).alias("_key"))
    rolling = F.transform(F.sequence(F.lit(0), F.size("_w") - K), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(K)]))
    votes = (d.filter(F.size("_w") >= K).select("_key", F.posexplode(rolling).alias("pos", "gram"))
             .join(F.broadcast(_template_table(spark)), F.col("gram") == F.col("g"))
             .groupBy("_key", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
             .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.bit_or("bit").alias("bits")))
    votes = settle(votes, "license-votes")
    names = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    all_bits = F.create_map(*[F.lit(x) for p in PHRASES for x in (p, (1 << (len(_parts(p)) - K + 1)) - 1)])
    places = (votes.filter(F.col("bits") == all_bits[F.col("template")])
              .groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(F.col("diagonal").alias("start"), names[F.col("template")].alias("label")))).alias("places")))
    by_offset = Window.partitionBy("_key", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(by_offset) <= DRIFT, 0).otherwise(1)
    size = F.create_map(*[F.lit(x) for kv in grams.items() for x in kv])
    near = by_offset.rangeBetween(-DRIFT, DRIFT)
    best = F.struct(F.bit_count("near_bits"), F.bit_count("bits"), -F.col("diagonal"))
    span = lambda start, stop, bits: F.struct(start.alias("start"), (stop + K).alias("stop"), (F.bit_count(bits) / size[F.col("template")]).alias("share"))
    holds = lambda s: (s["share"] >= share) & (s["stop"] - s["start"] <= 1.5 * (size[F.col("template")] + K) + DRIFT)
    spans = (votes.filter(F.col("template").isin(list(TEMPLATES)))
             .withColumn("apart", apart)
             .withColumns({"island": F.sum("apart").over(by_offset), "near_bits": F.bit_or("bits").over(near), "near_lo": F.min("lo").over(near), "near_hi": F.max("hi").over(near)})
             .withColumn("peak", best == F.max(best).over(near)))
    spans = (spans.groupBy("_key", "template", "island")
             .agg(span(F.min("lo"), F.max("hi"), F.bit_or("bits")).alias("run"),
                  F.collect_list(F.when(F.col("peak"), span(F.col("near_lo"), F.col("near_hi"), F.col("near_bits")))).alias("peaks"))
             .select("_key", "template", F.explode(F.when(holds(F.col("run")), F.array("run")).otherwise(F.filter("peaks", holds))).alias("s"))
             .select("_key", "s.start", "s.stop", F.regexp_replace("template", "-notice$", "").alias("label"), "s.share")
             .groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "label", "share"))).alias("spans")))
    found = settle(places.join(spans, "_key", "full"), "license-spans")
    none = {n: F.array().cast(t) for n, t in dict(found.dtypes).items() if n != "_key"}
    return (d.drop("_w").join(small_enough(found, SMALL), "_key", "left").drop("_key")
            .withColumns({n: F.coalesce(n, e) for n, e in none.items()}))


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best share; 1 for a phrase)."""
    d = scan(docs.select("doc_id", "text"))
    base = F.transform("places", lambda p: p["label"])
    both = F.concat(base, F.transform("spans", lambda s: s["label"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)))
    return d.select("row.doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                    joined(base).alias("base_labels"), joined(both).alias("labels"), score.alias("score"))
