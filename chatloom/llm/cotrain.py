"""Quality classifier by co-training: one view reads the text, the other its metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import held_out, packed, settle, small_enough
from chatloom.llm.quality import text_signals
from chatloom.llm.toxicity import fit_logistic, linear_score

#: Labelled rows outside the held-out fold that are fitted on at most; unlabelled ones are all used.
LABELLED = 20_000
#: Rounds, least confidence of a pseudo-label, weight of one, labelled ids that are broadcast at most.
ROUNDS, CONFIDENT, TRUST, SMALL = 4, 0.95, 0.3, 500_000
#: Places that sources and languages are hashed to.
HASHED = 24


def text_view() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.col(c) / n
    symbols = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / n
    return [F.log1p("n_words") / 5, F.least(symbols * 5, F.lit(2.0)), F.when(symbols > 0.05, 1.0).otherwise(0.0), share("n_caps"), F.when(share("n_caps") > 0.3, 1.0).otherwise(0.0),
            share("n_shouted"), dup, F.when((dup > 0.3) & (F.col("n_lines") >= 4), 1.0).otherwise(0.0), share("n_distinct"), F.when((share("n_distinct") < 0.3) & (n >= 30), 1.0).otherwise(0.0),
            share("n_common"), F.when(F.col("n_words") < 10, 1.0).otherwise(0.0), mean / 10, share("n_repeat_words"), F.when(share("n_repeat_words") > 0.2, 1.0).otherwise(0.0)]


def metadata_view() -> list[Column]:
    """Source and language by hashed places, and the size that the source states: nothing of the text."""
    at = lambda c: F.pmod(F.xxhash64(F.lit(c), F.coalesce(F.col(f"row.{c}").cast("string"), F.lit(""))), F.lit(HASHED))
    size = F.coalesce(F.col("row.n_chars").cast("double"), F.lit(0.0))
    size = F.log1p(F.greatest(size, F.lit(0.0)))
    return [size / 8, F.pow(size / 8, F.lit(2.0)), F.when(size < 4, 1.0).otherwise(0.0), at("source"), at("lang")]


#: Columns of the table of features: those of the text, and of the metadata the size and two places.
TEXT = [f"t{i}" for i in range(15)]
META = ["m0", "m1", "m2", "source_at", "lang_at"]


def _views(f: pd.DataFrame) -> dict[str, np.ndarray]:
    """Both views of some rows of the table of features as matrices, the constant last."""
    n, one = len(f), np.ones((len(f), 1))
    places = [(f[c].to_numpy()[:, None] == np.arange(HASHED)).astype(float) for c in META[3:]]
    return {"text": np.hstack([f[TEXT].to_numpy(float).reshape(n, -1), one]), "meta": np.hstack([f[META[:3]].to_numpy(float).reshape(n, -1), *places, one])}


def _columns(view: str) -> list[Column]:
    if view == "text":
        return [F.col(c) for c in TEXT]
    return [*[F.col(c) for c in META[:3]], *[F.when(F.col(c) == k, 1.0).otherwise(0.0) for c in META[3:] for k in range(HASHED)]]


def _score(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _given(views: dict[str, np.ndarray], past: list[dict]) -> dict[str, np.ndarray]:
    """Per view the labels that the other one gives it, NaN for none: those of a later round replace earlier ones."""
    out = {k: np.full(len(x), np.nan) for k, x in views.items()}
    for models in past:
        for k, other in (("text", "meta"), ("meta", "text")):
            w, fit = models[k]
            z = _logit(_score(w, views[k]))
            p = 1 / (1 + np.exp(-np.clip(z * fit[0] + fit[1], -30, 30)))
            out[other] = np.where(p >= CONFIDENT, 1.0, np.where(1 - p >= CONFIDENT, 0.0, out[other]))
    return out


def _sums(x: np.ndarray, y: np.ndarray, weight: float, w: np.ndarray) -> np.ndarray:
    """Gradient, Hessian and weight of some rows in one array."""
    p = _score(w, x)
    return np.concatenate([weight * (x.T @ (p - y)), weight * ((x * (p * (1 - p))[:, None]).T @ x).ravel(), [weight * len(y)]])


def pool_sums(pool: DataFrame, past: list[dict], w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The sums of both views over all rows of the pool that get a pseudo-label: added up by Spark, a few thousand numbers come back."""
    sizes = {k: len(v) + len(v) ** 2 + 1 for k, v in w.items()}

    def run(frames):
        total = {k: np.zeros(n) for k, n in sizes.items()}
        for f in frames:
            views = _views(f)
            for k, y in _given(views, past).items():
                rows = ~np.isnan(y)
                total[k] += _sums(views[k][rows], y[rows], TRUST, w[k])
        every = np.concatenate([total[k] for k in sizes])
        yield pd.DataFrame({"k": np.arange(len(every)), "v": every})

    every = np.zeros(sum(sizes.values()))
    for r in pool.mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        every[r["k"]] = r["v"]
    return dict(zip(sizes, np.split(every, np.cumsum(list(sizes.values()))[:-1])))


def _fit(views: dict[str, np.ndarray], y: np.ndarray, pool: DataFrame, past: list[dict], start: dict[str, np.ndarray], ridge: float = 1e-2, rounds: int = 40) -> dict[str, np.ndarray]:
    """Both regressions by Newton steps over the labelled rows and the pool: what ``fit_logistic`` gives over all of them at once."""
    w = dict(start)
    for _ in range(rounds):
        most, pooled = 0.0, pool_sums(pool, past, w)
        for k, x in views.items():
            n = x.shape[1]
            sums = _sums(x, y, 1.0, w[k]) + pooled[k]
            pen = np.full(n, ridge * max(1.0, sums[-1] / 100))
            pen[-1] = 1e-6
            step = np.linalg.solve(sums[n:-1].reshape(n, n) + np.diag(pen + 1e-9), sums[:n] + pen * w[k])
            w[k] = w[k] - np.clip(step, -2, 2)
            most = max(most, np.abs(step).max())
        if most < 1e-4:  # steps square the error
            break
    return w


def co_train(views: dict[str, np.ndarray], y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS) -> dict:
    """Two logistic regressions that label rows of the pool for each other, and a third that combines their log odds.

    A quarter of the labelled rows is kept from the views: it decides how far a view's confidence can be trusted (its calibrated
    probability must reach CONFIDENT) and calibrates the combination. A view that can't be that sure hands out nothing. The pool
    is never held: labels follow from the models of the rounds, so each step derives them again while it adds up."""
    late = np.arange(len(y)) % 4 == 3
    if len(set(y[late])) < 2 or len(set(y[~late])) < 2:
        late = np.zeros(len(y), bool)
    early = ~late if late.any() else np.ones(len(y), bool)
    check = late if late.any() else early
    mine = {k: x[early] for k, x in views.items()}
    w = {k: fit_logistic(x[:, :-1], y[early]) for k, x in mine.items()}
    past: list[dict] = []
    for _ in range(0 if pool.isEmpty() else rounds):
        past.append({k: (w[k], fit_logistic(_logit(_score(w[k], x[check]))[:, None], y[check])) for k, x in views.items()})
        w = _fit(mine, y[early], pool, past, w)
    both = np.column_stack([_logit(_score(w[k], views[k])) for k in ("text", "meta")])
    return {"text": w["text"], "meta": w["meta"], "both": fit_logistic(both[check], y[check])}


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, TEXT, META): a row per row."""
    names = ("source", "lang", "n_chars")
    row = docs.select("doc_id", "text", *[c if c in docs.columns else F.lit(None).cast("string").alias(c) for c in names])
    return text_signals(packed(row)).select(F.col("row.doc_id").alias("doc_id"), *[c.cast("double").alias(n) for n, c in zip(TEXT, text_view())],
                                            *[c.cast("int" if n.endswith("_at") else "double").alias(n) for n, c in zip(META, metadata_view())])


def quality_scores(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source, lang, n_chars): doc_id, held_out, score, predicted, kept, text_score, meta_score.

    The text view reads counts of the whole text, the metadata view source, language and stated size. Both are fitted on
    at most ``labelled`` labelled documents outside the held-out fold (crc32 of the id, mod 5; those with the least hash, one row
    of an id) and on all documents without a label. All rows are scored, by native functions. Null and empty texts count as texts
    without words, null metadata as a value of its own. Without labels of both kinds every score is 0.5. Equal rows score alike."""
    rows = settle(featured(docs), "co-features")
    known = settle(labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y")), "co-known")
    fit_on = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    one = F.min(F.struct("y", *TEXT, *META)).alias("one")
    sample = pd.DataFrame([r.asDict() for r in rows.join(F.broadcast(fit_on), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.*").orderBy("doc_id").collect()],
                          columns=["doc_id", "y", *TEXT, *META])
    y = sample["y"].to_numpy(float)
    if len(set(y)) < 2:
        w = {"text": np.zeros(len(TEXT) + 1), "meta": np.zeros(len(_columns("meta")) + 1), "both": np.zeros(3)}
    else:
        pool = rows.join(small_enough(known.select("doc_id"), SMALL), "doc_id", "left_anti").drop("doc_id")
        w = co_train(_views(sample), y, settle(pool, "co-pool"))

    def log_odds(p):
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
        return F.log(p / (1 - p))

    d = rows.select("doc_id", *[linear_score(_columns(k), w[k]).alias(f"{k}_score") for k in ("text", "meta")])
    d = d.withColumn("score", linear_score([log_odds(F.col("text_score")), log_odds(F.col("meta_score"))], w["both"]))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
                    (F.col("score") >= 0.5).alias("kept"), "text_score", "meta_score")
