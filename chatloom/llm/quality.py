"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import SPACE, packed, settle, words

#: Frequent words of the languages in the corpus, fixed values.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "ist", "im", "ein", "eine",
    "de", "la", "le", "les", "et", "des", "un", "une", "est", "que", "du", "en", "pas", "par", "sur", "el", "los", "se", "las", "con", "del", "para",
]
WINDOW = 5


def _repeated(grams: Column, width: int = WINDOW) -> Column:
    """Words inside windows whose content comes twice or more. ``grams``: a hash per window, by position.

    Sorted pairs (hash, position) bring equal windows together; their positions in order give the covered words."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    after = F.slice(pairs, F.lit(2), F.size(pairs))
    # a pair is repeated if its neighbour on either side has its hash
    touching = F.filter(F.transform(F.arrays_zip(pairs.alias("x"), after.alias("y")),
                                    lambda z: F.when(z["x"]["h"] == z["y"]["h"], F.array(z["x"]["i"], z["y"]["i"]))),
                        lambda z: z.isNotNull())
    at = F.sort_array(F.array_distinct(F.flatten(touching)))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(at, start, lambda a, p: F.struct(
        (p + width).alias("end"), (a["n"] + p + width - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])


def text_signals(df: DataFrame, text: str = "row.text") -> DataFrame:
    """Adds to ``df`` the counts that the rules read. Whole texts; null is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = df.withColumn("_words", words(t)).withColumn("_lines", lines)
    w = F.col("_words")
    gram = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    caps = lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1)
    d = d.select(
        *df.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.size(F.filter("_words", caps)).cast("long").alias("n_caps"),
        F.size(F.filter("_words", lambda x: F.lower(x).isin(COMMON_WORDS))).cast("long").alias("n_common"),
        F.size(F.filter("_words", lambda x: x.rlike(r"[!?]{2}"))).cast("long").alias("n_shouted"),
        F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), gram)).alias("_grams"))
    d = d.withColumn("_differ", F.size(F.array_distinct("_grams")))
    return d.withColumn("n_repeat_words", F.when(F.col("_grams").isNull() | (F.col("_differ") == F.size("_grams")), 0)
                        .otherwise(_repeated(F.col("_grams"))).cast("long")).drop("_grams", "_differ")


def _vote(bad: Column, good: Column) -> Column:
    """-1 bad, 1 good, 0 abstains. Rules that look for one defect have nothing to say where it is absent."""
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def rule_votes() -> dict[str, Column]:
    """Each rule's vote. Rules abstain where the text is too short for them or the sign is weak."""
    n, long = F.col("n_words"), F.col("n_words") >= 10
    share = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    symbols = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "v_symbols": _vote(symbols > 0.05, F.lit(False)),
        "v_repeats": _vote(long & (share("n_repeat_words") > 0.2), F.lit(False)),
        "v_lines": _vote((F.col("n_lines") >= 4) & (dup > 0.3), F.lit(False)),
        "v_caps": _vote(long & (share("n_caps") > 0.3), F.lit(False)),
        "v_shouted": _vote(long & (share("n_shouted") > 0.1), F.lit(False)),
        "v_length": _vote(n < 10, n >= 30),
        "v_common": _vote((n >= 30) & (share("n_common") < 0.01), (n >= 30) & (share("n_common") > 0.08)),
        "v_shape": _vote(long & ((mean < 2) | (mean > 14)), long & (mean >= 3) & (mean <= 10)),
    }


#: What is known of the rules beforehand: a bad vote falls on at most 2 % of good texts.
FALSE_ALARM = 0.02


def estimate_accuracies(patterns: DataFrame, rules: list[str], rounds: int = 30, prior: float = 0.8) -> dict:
    """EM over vote patterns (one row for each combination of votes that occurs, with its count ``n``: at most
    3 to the number of rules rows). Each rule has four rates: bad and good votes on good texts, bad and good votes
    on bad texts; it abstains otherwise. Each round is one aggregation; only its sums come back. Bounds keep
    good and bad from changing places: FALSE_ALARM, and a good vote is likelier on a good text."""
    rates = {r: (0.01, 0.6, 0.3, 0.4) for r in rules}
    for _ in range(rounds):
        n, g = F.col("n"), F.col("n") * F.col("_q")
        sums = patterns.withColumn("_q", posterior(rules, prior, rates)).agg(F.sum(n).alias("n"), F.sum(g).alias("g"), *[
            F.sum(F.when(F.col(r) == v, w)).alias(f"{r}{v}{k}") for r in rules for k, w in (("g", g), ("b", n - g)) for v in (-1, 1)]).first()
        if not sums["n"]:
            break
        s = {k: v or 0.0 for k, v in sums.asDict().items()}
        good, bad = s["g"], s["n"] - s["g"]
        new = {}
        for r in rules:
            alarm = min(FALSE_ALARM, (s[f"{r}-1g"] + 0.01) / (good + 1))
            catch = min(0.98, max(FALSE_ALARM, (s[f"{r}-1b"] + 0.3) / (bad + 1)))
            praise = min(0.97, max(0.001, (s[f"{r}1g"] + 0.6) / (good + 1)))
            spared = min(praise, 1 - catch - 0.005, max(0.001, (s[f"{r}1b"] + 0.4) / (bad + 1)))
            new[r] = (alarm, praise, catch, spared)
        moved = max(abs(a - b) for r in rules for a, b in zip(new[r], rates[r]))
        prior, rates = min(0.99, max(0.01, good / s["n"])), new
        if moved < 1e-4:
            break
    return {"prior": prior, "rates": rates}


def posterior(rules: list[str], prior: float, rates: dict) -> Column:
    """Probability that a text is good, given the votes."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for r in rules:
        alarm, praise, catch, spared = rates[r]
        odds = odds + (F.when(F.col(r) == -1, math.log(alarm / catch)).when(F.col(r) == 1, math.log(praise / spared))
                       .otherwise(math.log((1 - alarm - praise) / (1 - catch - spared))))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs``: ``row`` (the columns ``carry``, by default all), the signals, base_failed, quality, kept.

    Votes are counted over all rows into a table of patterns, EM fits the rules on it, and the posterior decides
    in place of demanding that every rule passes. ``base_failed`` texts (under 10 words, or over a fifth of the
    words in repeated windows) are never kept. Null text is an empty one and fails. No rows give no rows. Equal rows
    are judged alike. Native functions only."""
    votes = rule_votes()
    rules = list(votes)
    d = text_signals(packed(docs))
    if carry is not None:
        d = d.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in carry]))
    d = settle(d.select("*", *[c.alias(k) for k, c in votes.items()]), "quality")
    patterns = settle(d.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).coalesce(1).sortWithinPartitions(*rules), "votes")
    fit = estimate_accuracies(patterns, rules)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (d.withColumn("base_failed", failed).withColumn("quality", posterior(rules, fit["prior"], fit["rates"]))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))
