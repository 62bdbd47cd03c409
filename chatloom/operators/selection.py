"""Choosing which chats to process: list stamps, the ledger of earlier runs, and request lists."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.stamps import stamp_older_than, window_cutoff
from ..functions.similarity import variant_of_any
from ..functions.timelabel import wall_seconds
from .entities import resolve_stamp
from .scan import carry_scan, slice_of, ROWS_PER_SLICE


def limit_chats(names: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The first ``n`` names in list order; 0 means all."""
    return names.orderBy(order).limit(n) if n else names


def tail_cut(kept: DataFrame, keys: list[str], order: str = "pos", older: str = "older") -> DataFrame:
    """A list runs from recent to old, so everything after its last row that is proven recent goes. A list
    without such a row stays whole. The cut is one maximum per list, not an ordered window."""
    last = (kept.filter(F.col(older) == F.lit(False)).groupBy(*keys).agg(F.max(order).alias("_last")))
    return kept.join(last, keys, "left").filter(F.col("_last").isNull() | (F.col(order) <= F.col("_last"))).drop("_last")


def select_active(names: DataFrame, stamps: DataFrame, spec: str, as_of: datetime, keys: list[str],
                  order: str = "pos", variants: bool = True) -> DataFrame:
    """Names whose chat can hold messages inside the window: drop what is proven old, then cut the tail."""
    cutoff = window_cutoff(spec, as_of)
    if cutoff is None:
        return names
    stamped = resolve_stamp(names, stamps, keys, order, variants)
    judged = stamped.withColumn("older", stamp_older_than("stamp", cutoff, as_of.date()))
    return tail_cut(judged.filter(F.coalesce("older", F.lit(False)) == F.lit(False)), keys, order)


def skip_reason(names: DataFrame, cutoff: date | None, as_of: date, skip: tuple[str, ...] = K.SYSTEM_CHATS,
                only: list[str] | None = None, variants: bool = True) -> DataFrame:
    """Why a name is skipped: system, not-only, done, error or old, in this order; NULL means process.
    ``names`` carries ``status`` (ledger) and ``stamp``, see ``entities.ledger_status`` and
    ``entities.resolve_stamp``."""
    name = F.col("name")
    system = name.isin(*skip) if skip else F.lit(False)
    out = names
    wanted = F.lit(True)
    if only is not None:
        wanted = F.lit(False)
        for o in only:
            wanted = wanted | name.contains(o) | F.lit(o).contains(name)
        if variants:
            out = out.withColumn("_variant", variant_of_any(name, only))
            wanted = wanted | F.col("_variant")
    old = F.lit(False) if cutoff is None else F.coalesce(stamp_older_than("stamp", cutoff, as_of), F.lit(False))
    reason = (F.when(system, "system").when(~wanted, "not-only").when(F.col("status") == "error", "error")
              .when(F.col("status") == "done", "done").when(old, "old"))
    return out.withColumn("reason", reason).drop("_variant")


def ledger_latest(ledger: DataFrame, order: list[str], keys: list[str] = []) -> DataFrame:
    """The latest ledger row of each name."""
    cols = [c for c in ledger.columns if c not in (*keys, "name")]
    return (ledger.groupBy(*keys, "name").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
            .select(*keys, "name", *[F.col(f"r.{c}").alias(c) for c in cols]))


def drop_failed(latest: DataFrame) -> DataFrame:
    """Retry: a failed name counts as never processed."""
    return latest.filter(F.col("status") != "error")


def batch_summary(ledger: DataFrame, skipped: DataFrame, by: list[str] = []) -> DataFrame:
    """done, failed, skipped and messages of one run (or of each ``by``)."""
    ok = F.col("status") == "done"
    run = ledger.groupBy(*by).agg(F.count_if(ok).alias("done"), F.count_if(F.col("status") == "error").alias("failed"),
                                  F.sum(F.when(ok, F.col("messages")).cast("long")).alias("messages"))
    left = skipped.groupBy(*by).agg(F.count("*").alias("skipped"))
    both = run.unionByName(left, allowMissingColumns=True).groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("done", "failed", "skipped", "messages")])
    return both.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("done", "failed", "skipped", "messages")])


def progress_every_n(ledger: DataFrame, keys: list[str], n: int = 5, order: str = "seq", at: str = "at") -> DataFrame:
    """At every ``n``-th success of a run: successes, failures and messages so far and mean whole seconds per
    success since the run began. Running sums travel slice by slice."""
    ok = F.col("status") == "done"
    start = ledger.groupBy(*keys).agg(F.min(at).alias("_start"))
    run = carry_scan(ledger, keys, slice_of(order, ROWS_PER_SLICE), [F.col(order)], total={
        "done": ok.cast("long"), "failed": (~ok).cast("long"),
        "total_messages": F.when(ok, F.col("messages")).otherwise(0).cast("long")})
    at_nth = run.filter(ok & (F.col("done") % n == 0))
    secs = wall_seconds(at) - wall_seconds("_start")
    return (at_nth.join(start, keys)
            .select(*keys, order, "done", "failed", F.col("total_messages").alias("messages"),
                    F.floor(secs / F.col("done")).alias("mean_seconds")))
