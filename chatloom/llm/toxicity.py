"""Toxicity: a learnt lexicon, matched through misspellings, and weights that separate quotation from abuse."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.common import held_out, settle
from chatloom.llm.grams import REMEMBERED

#: Labelled rows that lexicon and weights are learnt from at most (those with the least hash), terms kept at most.
LABELLED, TERMS = 20_000, 400
#: Words around a term that tell quotation from abuse, fixed values; WINDOW words on either side are looked at.
WINDOW = 6
REPORTING = {b"said", b"says", b"called", b"calls", b"wrote", b"writes", b"quoted", b"quote", b"word", b"words", b"term", b"phrase", b"reported", b"testified", b"slur", b"insult", b"epithet"}
ADDRESS = {b"you", b"your", b"youre", b"you're", b"u", b"ur", b"yourself"}
#: Insults that are looked for even if no label tells, fixed values.
SEEDS = {"idiot", "idiots", "imbecile", "loser", "losers", "moron", "morons", "pathetic", "scum", "stupid", "worthless", "dumbass", "retard", "scumbag", "jackass", "bastard"}
STRIP = b".,;:!?()[]{}<>\"'`*#$%&|_-~/\\"
QUOTES = re.compile(rb"\"|\xe2\x80\x9c|\xe2\x80\x9d|\xc2\xab|\xc2\xbb|(?m:^)>")
FEATURES = ["exact", "near", "far", "quoted", "addressed", "many", "dense"]


class Automaton:
    """Levenshtein automata of all terms intersected with the trie of the terms, made deterministic as words need it.

    A state is the set of (trie node, errors) that the letters read so far can reach. Words that leave
    every term behind end in the empty state after a few letters."""

    def __init__(self, terms: list[str]):
        self.kids, self.term, self.most = [{}], [None], [0]
        for t in sorted(terms):
            at, allowed = 0, self.allowed(t)
            self.most[0] = max(self.most[0], allowed)
            for c in t:
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.term.append(None)
                    self.most.append(0)
                at = self.kids[at][c]
                self.most[at] = max(self.most[at], allowed)
            self.term[at] = t
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple | None] = []
        self.start = self._number({(0, 0)})

    @staticmethod
    def allowed(term: str) -> int:
        """Edits that still leave a term recognisable."""
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def _number(self, state: set) -> int:
        todo = list(state)
        while todo:  # letters of the term that the word leaves out
            node, e = todo.pop()
            for kid in self.kids[node].values():
                if e < self.most[kid] and (kid, e + 1) not in state:
                    state.add((kid, e + 1))
                    todo.append((kid, e + 1))
        least: dict[int, int] = {}
        for node, e in state:
            least[node] = min(e, least.get(node, e))
        key = tuple(sorted(least.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, self.term[node]) for node, e in key if self.term[node] and e <= self.allowed(self.term[node])]
            self.ends.append(min(ends) if ends else None)
        return self.numbers[key]

    def match(self, word: str) -> tuple | None:
        """(errors, term) of the closest term within its bound."""
        at = self.start
        for c in word:
            to = self.moves[at].get(c)
            if to is None:
                after = set()
                for node, e in self.states[at]:
                    for letter, kid in self.kids[node].items():
                        if e + (letter != c) <= self.most[kid]:
                            after.add((kid, e + (letter != c)))
                    if e < self.most[node]:
                        after.add((node, e + 1))
                to = self.moves[at][c] = self._number(after)
            if not self.states[to]:
                return None
            at = to
        return self.ends[at]


class Matches(dict):
    """Word (bytes, lower case) to its match; keeps what it has met."""

    def __init__(self, terms):
        super().__init__()
        self.automaton = Automaton(terms)

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        bare = word.strip(STRIP)
        m = self[word] = self.automaton.match(bare.decode().lower()) if bare else None
        return m


def text_features(text: str | None, matches: Matches) -> list[float]:
    """Counts of a whole text: terms met exactly, with one edit, with more; those quoted, those addressed to someone."""
    b = (text or "").encode().lower()
    words = b.split()
    found = [(i, m) for i, m in enumerate(map(matches.__getitem__, words)) if m]
    if not found:
        return [0.0] * len(FEATURES)
    f = dict.fromkeys(FEATURES, 0.0)
    for i, (errors, _) in found:
        f["exact" if errors == 0 else "near" if errors == 1 else "far"] += 1
        around = words[max(0, i - WINDOW):i + WINDOW + 1]
        bare = {w.strip(STRIP) for w in around}
        before, after = b" ".join(words[max(0, i - WINDOW):i + 1]), b" ".join(words[i:i + WINDOW + 1])
        f["quoted"] += bool(bare & REPORTING) or bool(QUOTES.search(before) and QUOTES.search(after))
        f["addressed"] += bool(bare & ADDRESS)
    n = len(found)
    return [float(np.log1p(f["exact"])), float(np.log1p(f["near"])), float(np.log1p(f["far"])), f["quoted"] / n, f["addressed"] / n, float(n > 1), n / len(words)]


def _learnt(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, y): at most ``most`` labelled rows outside the held-out fold, the mean label of an id that has several."""
    return (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def learn_lexicon(sample: DataFrame, terms: int = TERMS, lift: float = 10.0, least: int = 3, evidence: float = 16.0) -> list[str]:
    """SEEDS and the words of which toxic texts hold more. ``sample``: text, y. Words are counted once a text.

    A word's odds must be ``lift`` times the usual ones, and its texts must speak against chance by ``evidence`` nats
    (their number times the divergence of the word's rate from the usual one): few chance words among millions pass."""
    low = F.lower(F.coalesce("text", F.lit("")))
    word = F.explode(F.array_distinct(F.split(F.regexp_replace(low, r"[^\p{L}\p{M}']+", " "), " "))).alias("w")
    seen = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).first()
    every, toxic = seen["n"] or 0, seen["t"] or 0.0
    if not toxic or toxic == every:
        return sorted(SEEDS)
    base, t, n = toxic / every, F.col("t"), F.col("n")
    rate = ((t + 0.1) / toxic) / ((n - t + 0.5) / (every - toxic))
    spoken = t * F.log(t / n / base) + F.when(n > t, (n - t) * F.log((n - t) / n / (1 - base))).otherwise(0.0)
    rows = (sample.select(word, "y").filter(F.length("w") >= 4).groupBy("w").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n"))
            .filter((t >= least) & (rate >= lift) & (spoken >= evidence)).orderBy(F.desc(spoken), "w").limit(terms).collect())
    return sorted(SEEDS | {r["w"] for r in rows})


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    s = np.ones(len(x)) if weight is None else weight
    pen = np.full(a.shape[1], ridge * max(1.0, s.sum() / 100))
    pen[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (s * (p - y)) + pen * w
        hess = (a * (s * p * (1 - p))[:, None]).T @ a + np.diag(pen + 1e-9)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def linear_score(features: list[Column], weights) -> Column:
    """The regression as a column."""
    z = F.lit(float(weights[-1]))
    for f, w in zip(features, weights):
        z = z + f * F.lit(float(w))
    return 1 / (1 + F.exp(-z))


def features_udf(terms: list[str]):
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matches = Matches(terms)
        for texts in batches:
            yield pd.Series([text_features(t, matches) for t in texts])

    return F.pandas_udf(features, T.ArrayType(T.DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    A lexicon is learnt from at most ``labelled`` labelled rows outside the held-out fold (crc32 of the id, mod 5), one row of an id, which
    also weigh what a match means: exact or misspelt, quoted or addressed, single or repeated. Whole texts are matched. Null
    and empty texts have no match and get the base score; so does every text if no label is known. Equal texts score alike. The
    sample of labels is broadcast: its size is bounded by ``labelled``."""
    picked = settle(_learnt(labels, labelled), "labelled")
    # one row of an id: however many it has, it counts once
    sample = settle(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("one")).select("one.*"), "toxic-sample")
    terms = learn_lexicon(sample)
    featured = features_udf(terms)
    rows = sample.select("y", featured("text").alias("f")).collect()
    y = np.array([r["y"] for r in rows], float)
    if len(y) and 0 < y.mean() < 1:
        w = fit_logistic(np.array([r["f"] for r in rows], float), y)
    else:
        w = np.zeros(len(FEATURES) + 1)
        w[-1] = -3.0 if not len(y) or y.mean() == 0 else 3.0
    d = docs.select("doc_id", featured("text").alias("_f"))
    score = linear_score([F.get("_f", F.lit(i)) for i in range(len(FEATURES))], w)
    return (d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))
