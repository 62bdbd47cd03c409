"""Entity resolution of chat names: which readings mean the same chat.

Pairs are never formed across whole lists. Every way two names can be variants forces them to share a
rare token, so names meet by equality on tokens, are checked against native bounds, and only then reach
the sequence ratio. ``keys`` (the list or account a name belongs to) keep lists apart.

Where a list is made of few characters its keys are crowded, and a pair would come out of the join once for each of them. The names
under such keys are compared block by block instead (``functions.grid``), and their pairs are made where they are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.grid import Block, Shelf, Texts, Tokens, linked, possible
from ..functions.similarity import Gathered, either_way, name_variant, same_reading, traits, variant_of_any
from ..functions.text import characters, norm_name
from ..session import settle, shared_dir
from .scan import SCREENS_PER_SLICE, fold_sorted, key_ddl, null_safe_join, slice_of


def _tokens(chars: Column) -> Column:
    """``chars``, the characters of a normalised name, numbered where they repeat, so that plain set intersection counts
    a common character as often as both names hold it."""
    return F.transform(chars, lambda c, i: F.concat(
        c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c)).cast("string")))


def _with_tokens(names: DataFrame) -> DataFrame:
    """Tokens, their number, and a map of them in two longs: a token whose bit the other name lacks is not in that name."""
    # the characters are a column of their own: inside the numbering they would be cut anew for each of them
    d = names.withColumn("_chars", characters(norm_name("name"))).withColumn("_tok", _tokens(F.col("_chars"))).drop("_chars").withColumn("_n", F.size("_tok"))
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(128)).cast("int")
    bit = lambda t, half: F.when(F.floor(place(t) / 64) == half, F.call_function("shiftleft", F.lit(1).cast("long"), place(t) % 64)).otherwise(F.lit(0).cast("long"))
    held = lambda half: F.aggregate("_tok", F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(bit(t, half)))
    return d.withColumns({f"_bits{half}": held(half) for half in (0, 1)})


def _common_at_most() -> Column:
    """A bound of the common tokens of ``name`` and ``other``, by counting bits."""
    missing = lambda a, b: sum((F.bit_count(F.col(f"{a}{h}").bitwiseAND(F.bitwise_not(F.col(f"{b}{h}")))) for h in (0, 1)), F.lit(0))
    return F.least(F.col("_n") - missing("_bits", "_other"), F.col("_m") - missing("_other", "_bits"))


def _rarest_first(names: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of each name in one global order, rare ones first. The table of counts has a row per
    distinct character and repeat, not per name."""
    each = names.select(*keys, "name", F.explode("_tok").alias("token"))
    ranked = each.join(counts, "token").groupBy(*keys, "name").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("_r"))
    part = lambda c, of: F.coalesce(F.transform("_r", lambda x: x[c]), F.array().cast(f"array<{of}>"))
    return (names.join(ranked.hint("merge"), [*keys, "name"], "left").withColumns({"_rare": part("token", "string"), "_often": part("df", "bigint")})
            .drop("_r"))


# How two names can meet, as the first part of a blocking key.
SAME, NUMBER, SHORT_IN_LONG, LONG_OVER_SHORT, DROPPED, KEPT = range(6)


def _probes(role: str) -> Column:
    """Blocking keys of a name as ``(kind, token, place)``. ``role`` is ``one`` or ``other``; the contained name
    of a pair may be on either side, so each side emits both its short-form and its long-form keys.

    same      overlap of at least 0.35 (la + lb) with close lengths: rare-token prefix on both sides
    inside    a window of the longer name covers 0.8 of the shorter: the shorter one's rare prefix
              against every token of the longer
    dropped   the shorter one keeps all its characters: its rarest token against the seven rarest
              of the longer, with the first character
    number    a digit run of six or more inside another: six-digit grams
    """
    n, rare = F.col("_n"), F.col("_rare")
    none = F.array().cast("array<string>")

    def keyed(kind: int, tokens: Column) -> Column:
        return F.transform(F.coalesce(tokens, none), lambda t, i: F.struct(
            F.lit(kind).alias("kind"), t.alias("token"), i.alias("place")))

    close = F.ceil(F.lit(K.FUZZY_RATIO / 2) * (2 * n - F.greatest(F.lit(2), F.floor(n / 3))) - F.lit(1e-9))
    same = F.when(n >= 2, F.slice(rare, F.lit(1), F.greatest(F.lit(1), n - close + 1).cast("int")))
    cover = F.ceil(F.lit(K.WINDOW_RATIO) * n - F.lit(1e-9))
    short_in = F.when(n >= 4, F.slice(rare, F.lit(1), (n - cover + 1).cast("int")))
    first = F.substring(norm_name("name"), 1, 1)
    short_drop = F.when(n >= 4, F.transform(F.slice(rare, 1, 1), lambda t: F.concat(first, t)))
    long_drop = F.when(n >= 5, F.transform(F.slice(rare, 1, 7), lambda t: F.concat(first, t)))
    # this side's short form meets the other side's long form, and the other way round
    short, long, cut, full = ((SHORT_IN_LONG, LONG_OVER_SHORT, DROPPED, KEPT) if role == "one"
                              else (LONG_OVER_SHORT, SHORT_IN_LONG, KEPT, DROPPED))
    return F.flatten(F.array(keyed(SAME, same), keyed(NUMBER, F.array_distinct("_num")), keyed(short, short_in),
                             keyed(long, F.when(n >= 5, rare)), keyed(cut, short_drop), keyed(full, long_drop)))


def _fits() -> Column:
    """Length bounds of a meeting, how many characters two names can have in common at most, and for ``same`` how many common
    characters can still follow the first common token. A later common token may fail this; the first one of a real pair
    never does. All of it is counted inside the join, so what cannot be a pair never leaves it."""
    n, m, kind = F.col("_n"), F.col("_m"), F.col("_p.kind")
    rest = F.least(n - F.col("_p.place"), m - F.col("_q.place"))
    gap, common = F.abs(n - m), _common_at_most()
    same, inside = K.FUZZY_RATIO / 2 * (n + m) - 1e-9, K.WINDOW_RATIO * F.least(n, m) - 1e-9
    return (F.when(kind == SAME, (gap <= F.greatest(F.lit(2), F.floor(F.greatest(n, m) / 3))) & (rest >= same) & (common >= same))
            .when(kind == SHORT_IN_LONG, (n < m) & (common >= inside)).when(kind == LONG_OVER_SHORT, (n > m) & (common >= inside))
            .when(kind == DROPPED, (n < m) & (gap <= 6) & (common >= n)).when(kind == KEPT, (n > m) & (gap <= 6) & (common >= m)).otherwise(True))


def _possible() -> Column:
    """Native bounds every variant pair meets; cheap, and ahead of the Python ratio."""
    la, lb = F.col("_n_a"), F.col("_n_b")
    common = F.size(F.array_intersect("_tok_a", "_tok_b"))
    short, long = F.least(la, lb), F.greatest(la, lb)
    fuzzy = (short >= 2) & (F.abs(la - lb) <= F.greatest(F.lit(2), F.floor(long / 3))) & (common >= K.FUZZY_RATIO / 2 * (la + lb) - 1e-9)
    inside = (short >= 4) & (long > short) & (common >= K.WINDOW_RATIO * short - 1e-9)
    number = F.arrays_overlap("_num_a", "_num_b")
    return fuzzy | inside | number


def _digit_grams() -> Column:
    runs = F.regexp_extract_all("name", F.lit(r"(?U)\d{6,}"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(F.lit(1), F.length(r) - 5), lambda i: F.substring(r, i, F.lit(6)))))


def _tokenised(sides: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """Names with their tokens, rare ones first. Stored: they are small next to what they come from and are
    read by each of the steps below."""
    n = int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # names are small and cutting them is not: they go over all partitions first, and are cut once
    sides = [settle(_with_tokens(d.select(*keys, "name").distinct().repartition(n, *keys, "name")), "tokens") for d in sides]
    counts = None
    for d in sides:
        t = d.select(F.explode("_tok").alias("token"))
        counts = t if counts is None else counts.unionAll(t)
    counts = counts.groupBy("token").agg(F.count("*").alias("df"))
    return _crowded([settle(_rarest_first(d, counts, keys).withColumn("_num", _digit_grams()), "names") for d in sides], keys)


# From how many members on its smaller side a key is crowded; how many comparisons in blocks take the time of one inside the join;
# names in a block.
CROWDED, PER_MEETING, BLOCK = 64, 8, 2048


def _by_list(names: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Names with what a table has on their list; without keys all are one list."""
    return names.join(other.hint("merge"), keys, how) if keys else names.crossJoin(other)


def _crowded(sides: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """Names with ``_dense``, whether they are compared block by block, and ``_sparse``, whether they meet others by blocking keys. Two
    names that are both dense meet in blocks only. All names of a list are dense where that costs less than its crowded keys, else those
    under a crowded key, else none."""
    l, r = sides[0], sides[-1]

    def probes(d: DataFrame, role: str) -> DataFrame:
        # only a token that is frequent at all can be crowded; numbers are not counted by token
        p = F.filter(_probes(role), lambda p: (p["kind"] == NUMBER) | (F.get("_often", p["place"]) >= CROWDED))
        return d.select(*keys, "name", F.explode(p).alias("_p")).select(*keys, "name", "_p.kind", "_p.token")

    members = lambda d, role, *n: probes(d, role).select(*keys, "kind", "token", *[F.lit(x).cast("double").alias(c) for x, c in zip(n, ("s", "t"))])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    full = settle(members(l, "one", 1, 0).unionAll(members(r, "other", 0, 1)).filter(known).groupBy(*keys, "kind", "token")
                  .agg(F.sum("s").alias("s"), F.sum("t").alias("t")).filter(F.least("s", "t") >= CROWDED), "crowded")
    if full.isEmpty():
        return [d.withColumns({"_dense": F.lit(False), "_sparse": F.lit(True)}) for d in sides]
    sizes = lambda d, as_: d.groupBy(*keys).agg(F.count("*").cast("double").alias(as_))
    lists = _by_list(_by_list(full.groupBy(*keys).agg(F.sum(F.col("s") * F.col("t") * PER_MEETING).alias("_met")), sizes(l, "_l"), keys), sizes(r, "_r"), keys)
    lists = settle(lists.select(*keys, "_met", (F.col("_l") * F.col("_r") <= F.col("_met")).alias("_whole")), "lists")
    some = _by_list(full, lists.filter("NOT _whole"), keys).select(*keys, "kind", "token", "_met")
    under = [settle(probes(d, role).join(some.hint("merge"), [*keys, "kind", "token"]).groupBy(*keys, "name").agg(F.first("_met").alias("_met")), "under-crowded")
             for d, role in ((l, "one"), (r, "other"))]
    both = lambda d, as_: d.groupBy(*keys).agg(F.count("*").cast("double").alias(as_), F.first("_met").alias("_met"))
    worth = _by_list(both(under[0], "_l"), both(under[1], "_r").drop("_met"), keys).filter("_l * _r <= _met").select(*keys, F.lit(True).alias("_worth"))

    def flagged(d: DataFrame, own: list[DataFrame]) -> DataFrame:
        for no, u in enumerate(own):
            part = _by_list(u.select(*keys, "name"), worth, keys).withColumnRenamed("_worth", f"_part{no}")
            d = d.join(part.hint("merge"), [*keys, "name"], "left")
        d = _by_list(d, lists.select(*keys, "_whole"), keys, "left")
        whole = F.coalesce("_whole", F.lit(False))
        dense = whole
        for no in range(len(own)):
            dense = dense | F.coalesce(f"_part{no}", F.lit(False))
        return settle(d.withColumns({"_dense": dense, "_sparse": ~whole}).drop("_whole", *[f"_part{no}" for no in range(len(own))]), "flagged")

    if len(sides) == 1:      # a name may be crowded in either role
        return [flagged(l, under)]
    return [flagged(l, under[:1]), flagged(r, under[1:])]


def _in_blocks(d: DataFrame, keys: list[str], as_: str, width: int | None = None) -> DataFrame:
    """Dense names with the block ``_b`` they are in, of ``as_`` blocks of about ``width`` on their list."""
    d = d.filter("_dense")
    d = _by_list(d, d.groupBy(*keys).agg(F.ceil(F.count("*") / (width or BLOCK)).cast("int").alias(as_)), keys)
    return d.withColumn("_b", F.pmod(F.xxhash64("name", F.lit(as_)), F.col(as_)).cast("int"))


def _block_pairs(l: DataFrame, r: DataFrame | None, keys: list[str], more: list[str] = [], width: int | None = None) -> DataFrame:
    """Names once for each pair of blocks (``_i``, ``_j``) that theirs is in; ``_side`` says in which place. Within one table each pair of blocks comes
    once, and one of a block with itself has it in the first place only. A pair of blocks is small and costs much: the number of partitions is fixed."""
    n = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias("_o")
    a = _in_blocks(l, keys, "_blocks", width)
    if r is None:
        rows = a.select(*keys, "name", *more, "_b", each("_blocks")).select(
            *keys, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), (F.col("_b") > F.col("_o")).alias("_side"), "name", *more)
    else:
        b = _in_blocks(r, keys, "_others", width)
        of = lambda d, as_: d.select(*keys, as_).distinct()
        rows = _by_list(a, of(b, "_others"), keys).select(*keys, "_b", "name", *more, each("_others")).select(*keys, F.col("_b").alias("_i"), F.col("_o").alias("_j"), F.lit(False).alias("_side"), "name", *more)
        rows = rows.unionAll(_by_list(b, of(a, "_blocks"), keys).select(*keys, "_b", "name", *more, each("_blocks")).select(
            *keys, F.col("_o").alias("_i"), F.col("_b").alias("_j"), F.lit(True).alias("_side"), "name", *more))
    return rows.repartition(n, *keys, "_i", "_j")


def _pairs_in_blocks(l: DataFrame, r: DataFrame | None, keys: list[str], scored: bool) -> DataFrame:
    """(name, other) pairs of dense names, those that can be variants or, ``scored``, those that are. They are formed and scored inside
    a task, each once, and never shuffled. Within one table they come both ways round."""
    within = r is None

    def run(pdf):
        import numpy as np

        tokens, out = Tokens(), [[np.zeros(0, dtype=object)] for _ in range(2)]
        first = Block(pdf["name"][~pdf["_side"]].tolist(), tokens)
        itself = within and pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
        second = first if itself else Block(pdf["name"][pdf["_side"]].tolist(), tokens)
        xs, ys = (np.array(b.names, dtype=object) for b in (first, second))
        texts = Texts(first, second) if scored else None
        for i, j in possible(first, second, later=itself):
            differ = xs[i] != ys[j]
            hits = texts.same(i, j) if scored else (differ, differ)
            for hit, one, other in ((hits[0], xs[i], ys[j]), (hits[1], ys[j], xs[i]))[:1 + within]:
                out[0].append(one[hit & differ])
                out[1].append(other[hit & differ])
        name, other = (np.concatenate(o) for o in out)
        # the key columns are repeated, so that they keep their type where nothing is found
        return pdf[keys].iloc[np.zeros(len(name), dtype=np.int64)].reset_index(drop=True).assign(name=name, other=other)

    schema = ", ".join([*([key_ddl(l, keys)] if keys else []), "name string", "other string"])
    # half as wide: all pairs of two blocks may be variants
    return _block_pairs(l, r, keys, width=BLOCK // 2).groupBy(*keys, "_i", "_j").applyInPandas(run, schema)


def _meet(l: DataFrame, r: DataFrame, keys: list[str], apart: Column, extra: list[str] = [], hubs: bool = False) -> DataFrame:
    """Distinct (name, other) that share a blocking key, fit in length and characters and satisfy ``apart``. With ``hubs`` each
    name meets only the least name under a key: as many pairs as keys, however full a key is. Spark sizes a side by its files, a small part of
    what its tokens and blocking keys are in memory, so neither here nor in ``_bounded`` is it left to choose a broadcast."""
    one = l.filter("_sparse").select(*keys, "name", "_n", "_bits0", "_bits1", *extra, F.explode(_probes("one")).alias("_p"))
    other = r.filter("_sparse").select(*keys, F.col("name").alias("other"), F.col("_n").alias("_m"), F.col("_bits0").alias("_other0"), F.col("_bits1").alias("_other1"),
                     *[F.col(c).alias(f"{c}_o") for c in extra], F.explode(_probes("other")).alias("_q"))
    if hubs:
        key = [*keys, F.col("_q.kind").alias("kind"), F.col("_q.token").alias("token")]
        least = other.groupBy(*key).agg(F.min(F.struct("other", "_m", "_other0", "_other1", F.col("_q.place").alias("place"))).alias("h"))
        other = least.select(*keys, *[F.col(f"h.{c}").alias(c) for c in ("other", "_m", "_other0", "_other1")],
                             F.struct("kind", "token", F.col("h.place").alias("place")).alias("_q"))
    other = other.hint("merge")
    meet = [one[k] == other[k] for k in keys] + [one["_p.kind"] == other["_q.kind"], one["_p.token"] == other["_q.token"], apart, _fits()]
    return one.join(other, meet).select(*[one[k] for k in keys], "name", "other").distinct()


def _bounded(met: DataFrame, l: DataFrame, r: DataFrame, keys: list[str]) -> DataFrame:
    side = lambda d, s, as_: d.select(*keys, F.col("name").alias(as_), *[
        F.col(c).alias(f"{c}_{s}") for c in ("_tok", "_n", "_num")])
    return (met.join(side(l, "a", "name").hint("merge"), [*keys, "name"]).join(side(r, "b", "other").hint("merge"), [*keys, "other"])
            .filter(_possible()).select(*keys, "name", "other"))


def _spread(pairs: DataFrame) -> DataFrame:
    """Scoring costs far more than its bytes suggest, so pairs go over all partitions first."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "name", "other")


def candidate_pairs(left: DataFrame, right: DataFrame | None = None, keys: list[str] = []) -> DataFrame:
    """Every (left, right) pair of distinct names that can be variants, as ``name`` and ``other``; within
    ``left`` if ``right`` is not given. Loses none; ``tests/test_entities.py`` checks it against all pairs."""
    l, r, crowded = _sides(left, right, keys)
    near = _sparse_pairs(l, r, keys)
    return near.unionByName(_pairs_in_blocks(l, r, keys, scored=False)) if crowded else near


def _sides(left: DataFrame, right: DataFrame | None, keys: list[str]) -> tuple[DataFrame, DataFrame | None, bool]:
    """Both sides with their tokens, the second None within one table, and whether any names are dense."""
    sides = _tokenised([left] if right is None else [left, right], keys)
    return sides[0], sides[1] if len(sides) > 1 else None, not sides[0].filter("_dense").isEmpty()


def _sparse_pairs(l: DataFrame, r: DataFrame | None, keys: list[str]) -> DataFrame:
    """Candidate pairs whose names are not both dense."""
    apart = ~(F.col("_dense") & F.col("_dense_o"))
    if r is not None:
        return _bounded(_meet(l, r, keys, (F.col("name") != F.col("other")) & apart, ["_dense"]), l, r, keys)
    # bounds are symmetric: within one table each pair is formed once and turned round at the end
    near = _bounded(_meet(l, l, keys, (F.col("name") < F.col("other")) & apart, ["_dense"]), l, l, keys)
    turn = F.array(F.struct("name", "other"), F.struct(F.col("other").alias("name"), F.col("name").alias("other")))
    return near.select(*keys, F.explode(turn).alias("_t")).select(*keys, "_t.name", "_t.other")


def variant_pairs(left: DataFrame, right: DataFrame | None = None, keys: list[str] = []) -> DataFrame:
    """Pairs where ``name`` (left) is a variant of ``other`` (right)."""
    l, r, crowded = _sides(left, right, keys)
    near = _spread(_sparse_pairs(l, r, keys)).filter(name_variant("name", "other"))
    return near.unionByName(_pairs_in_blocks(l, r, keys, scored=True)) if crowded else near


def components(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Connected components by alternating large-star and small-star steps: (id, root), root the least id.

    Each step at least halves tall trees, so rounds grow with the logarithm of the data. Every round is
    checkpointed to the shared folder: lineage stays short and a lost executor costs one round.
    """
    spark = nodes.sparkSession
    folder = shared_dir(spark, "components")

    def settle(df: DataFrame, no: int) -> DataFrame:
        path = f"{folder}/round-{no}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    e = settle(edges.select("u", "v").filter("u <> v").distinct(), 0)
    if e.isEmpty():
        return nodes.select(F.col(id_col), F.col(id_col).alias("root")).distinct()
    no, settled = 0, False
    while not settled:
        # large star: every neighbour above a node hangs on the least id around that node
        n = both(e)
        least = n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (n.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: every neighbour below a node hangs on the least of them
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        m = low.groupBy("u").agg(F.min("v").alias("m"))
        small = (low.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .union(m.select("u", F.col("m").alias("v"))).distinct())
        no += 1
        e = settle(small, no)
        # done when only stars are left: every node hangs on one other, and that one on none
        hanging = e.join(e.select(F.col("v").alias("u")), "u", "left_semi").select("u")
        torn = e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        settled = hanging.unionAll(torn).isEmpty()
    return (nodes.select(F.col(id_col)).distinct().join(e.select(F.col("u").alias(id_col), "v"), id_col, "left")
            .select(id_col, F.coalesce("v", F.col(id_col)).alias("root")))


class _Cluster:
    """Joins each name to the first cluster whose current longest reading it resembles. Many clusters are searched through a shelf."""

    FEW = 64

    def __init__(self):
        self.kept, self.shelf = [], None

    def row(self, values):
        pos, name = values
        if self.shelf is None and len(self.kept) > self.FEW:
            self.shelf = Shelf()
            for i, (_, n) in enumerate(self.kept):
                self.shelf.put(i, n)
        places = range(len(self.kept)) if self.shelf is None else self.shelf.near(name)
        for i in places:
            c = self.kept[i]
            if name == c[1] or same_reading(name, c[1]):
                if len(name) > len(c[1]):
                    self._put(i, name)
                    c[1] = name
                return ()
        self._put(len(self.kept), name)
        self.kept.append([pos, name])
        return ()

    def _put(self, i, name):
        if self.shelf is not None:
            self.shelf.put(i, name)

    def end(self):
        return [(p, n) for p, n in self.kept]


def dedupe_names(names: DataFrame, keys: list[str] = []) -> DataFrame:
    """One row per chat: variants merged, the longest reading kept at the first reading's position.

    The rule compares each name with what earlier names left behind, so it has an order. Names in
    different components of the variant graph never meet; each component is replayed on its own.
    ``names`` holds (keys, pos, name); repeats of a name collapse to the first position beforehand.
    """
    first = settle(names.groupBy(*keys, "name").agg(F.min("pos").alias("pos")), "first-readings")
    roots = variant_groups(first, keys)
    grouped = first.join(roots, [*keys, "name"]).select(*keys, "root", "pos", "name")
    kept = fold_sorted(grouped, [*keys, "root"], ["pos"], _Cluster,
                       f"{key_ddl(grouped, [*keys, 'root'])}, pos bigint, name string")
    return kept.drop("root")


def variant_groups(names: DataFrame, keys: list[str]) -> DataFrame:
    """Names with the ``root`` of their component in the variant graph.

    Two passes keep a large family of similar names from being scored pair by pair. First every name is
    scored against one hub per blocking key and hangs on the least name it is linked with, which joins most of a family. Then only
    pairs that hang on different names are formed. The links of both passes are closed together. Dense names are linked block by block, where
    names that hang together already are not compared.
    """
    (l,) = _tokenised([names], keys)
    l = l.withColumn("id", F.xxhash64(*keys, "name"))
    crowded = not l.filter("_dense").isEmpty()
    ids = lambda c: F.xxhash64(*keys, F.col(c))

    def by_keys(pairs: DataFrame) -> DataFrame:
        scored = _spread(_bounded(pairs, l, l, keys)).filter(either_way("name", "other"))
        return settle(scored.select(ids("name").alias("u"), ids("other").alias("v")), "links")

    near = by_keys(_meet(l, l, keys, F.col("name") != F.col("other"), hubs=True))
    if crowded:
        near = near.unionAll(_block_links(l, keys))
    # a star: each name on the least id it is linked with, if that is below its own
    star = near.unionAll(near.select("v", "u")).groupBy("u").agg(F.min("v").alias("v"))
    star = settle(star.select(F.col("u").alias("id"), F.least("u", "v").alias("root")), "stars")
    for _ in range(2):      # and on what those hang on
        up = star.select(F.col("id").alias("root"), F.col("root").alias("_up"))
        star = star.join(up, "root", "left").select("id", F.coalesce("_up", "root").alias("root"))
    rooted = l.join(star.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = (F.col("name") < F.col("other")) & (F.col("root") != F.col("root_o")) & ~(F.col("_dense") & F.col("_dense_o"))
    rest = by_keys(_meet(rooted, rooted, keys, apart, ["root", "_dense"]))
    roots = components(l.select("id"), near.unionAll(rest))
    return l.select(*keys, "name", "id").join(roots, "id").select(*keys, "name", "root")


def _block_links(l: DataFrame, keys: list[str]) -> DataFrame:
    """Links (u, v) that connect dense names as their variants do: first inside each block, then between what is one in two blocks, so
    that a pair of blocks leaves at most as many links as both have families."""
    n, either = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions")), lambda x, y: same_reading(x, y) or same_reading(y, x)

    def inside(pdf):
        labels = pdf["id"].to_numpy(copy=True)
        linked(Block(pdf["name"].tolist(), Tokens()), None, labels, either)
        return pdf.drop(columns="_b").assign(root=labels)

    def between(pdf):
        import numpy as np
        import pandas as pd

        tokens, one, other = Tokens(), pdf[~pdf["_side"]], pdf[pdf["_side"]]
        labels = np.concatenate([one["root"].to_numpy(), other["root"].to_numpy()])
        found = linked(Block(one["name"].tolist(), tokens), Block(other["name"].tolist(), tokens), labels, either)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    cut = _in_blocks(l.select(*keys, "name", "id", "_dense"), keys, "_blocks").select(*keys, "name", "id", "_dense", "_b").repartition(n, *keys, "_b")
    own = settle(cut.groupBy(*keys, "_b").applyInPandas(inside, ", ".join([*([key_ddl(l, keys)] if keys else []), "name string", "id bigint, _dense boolean, root bigint"])), "blocks")
    across = settle(_block_pairs(own, None, keys, ["root"]).filter("_i <> _j").groupBy(*keys, "_i", "_j").applyInPandas(between, "u bigint, v bigint"), "block-links")
    return own.select(F.col("id").alias("u"), F.col("root").alias("v")).unionAll(across)


class NameList:
    """Running list of chat names. ``offer`` puts a reading where it belongs: nowhere if it was met before or
    repeats an item of the previous screen, over a shorter reading among the last ``window`` names, or at
    the end."""

    def __init__(self, window: int, names: list[str] | None = None, met=None):
        self.window, self.names = window, names if names is not None else []
        self.met = met if met is not None else set()
        self.gone = 0       # names that were dropped in front of these
        self.recent = Gathered((i, n) for i, n in enumerate(self.names) if i >= len(self.names) - window)
        self.screen, self.shown = None, Gathered()

    def offer(self, name: str, before: list[str]) -> bool:
        """Whether the reading is a chat not met so far. ``before`` stays as it is while it is the same list."""
        place = self.place(name, before)
        return place is not None and place[1]

    def place(self, name: str, before: list[str]) -> tuple[int, bool] | None:
        """Where the reading was put, and whether that made the list longer."""
        if not name or name in before or name in self.met:
            return None
        if before is not self.screen:
            self.screen, self.shown = before, Gathered((i, b) for i, b in enumerate(before) if b)
        mine = traits(name)
        if any(same_reading(name, before[i]) for i in self.shown.near(mine)):
            return None
        count = len(self.names)
        at = next((no - self.gone for no in self.recent.near(mine) if same_reading(name, self.names[no - self.gone])), count)
        if at < count and len(self.names[at]) >= len(name):
            return None
        self.names[at:at + 1] = [name]
        self.recent.drop(at + self.gone if at < count else count + self.gone - self.window)
        self.recent.add(at + self.gone, mine)
        self.met.add(name)
        return at, at == count

    def forget(self) -> int:
        """Drop what is no longer among the last names; how many."""
        gone = max(0, len(self.names) - self.window)
        del self.names[:gone]
        self.gone += gone
        return gone


class _Piece:
    """A slice of a list, screen after screen, started from the names that the slices before it are thought to leave.

    Rows come as (turn, screen, pos, name, met, recent): first the names received, then the screen before the slice, then its own."""

    def __init__(self, window):
        self.window, self.list, self.received = window, None, []
        self.screen, self.now, self.before, self.new = None, [], [], 0

    def row(self, values):
        turn, screen, _, name, met, recent = values
        if turn == 0:
            self.received = list(recent)
            self.list = NameList(self.window, list(recent))
            return []
        if turn == 1:
            self.now.append(name)
            return []
        done = []
        if screen != self.screen:
            done = self._finished()
            self.screen, self.before, self.now, self.new = screen, self.now, [], 0
        self.now.append(name)
        if not met:
            self.new += self.list.offer(name, self.before)
        return done

    def _finished(self):
        return [] if self.screen is None else [("round", int(self.screen), None, self.new, None)]

    def end(self):
        names, k = self.list.names, len(self.received)
        longer = [("name", i - k, new, None, None) for i, (old, new) in enumerate(zip(self.received, names)) if old != new]
        added = [("name", i, n, None, None) for i, n in enumerate(names[k:])]
        put = [("put", None, n, None, None) for n in sorted(self.list.met)]
        return [*self._finished(), *longer, *added, *put, ("state", len(added), None, None, names[-self.window:])]


def merge_round_names(readings: DataFrame, keys: list[str], window: int = 16, width: int = SCREENS_PER_SLICE) -> DataFrame:
    """Running union of the names on consecutive screens of a list (keys, screen_idx, pos, name).

    Gives ``what = 'name'`` rows (no = position, name) and ``what = 'round'`` rows (no = screen, new = chats first met there).
    The rule depends on everything before, yet what a slice of ``width`` screens needs is little: the last ``window`` names, the screen
    before it (known beforehand) and which of its names were put on the list earlier. All slices are replayed at once from
    guesses; then each is compared with what the others left, and only slices that started from something else are
    replayed. When none is left the result is that of one walk: the first slice starts right, and so does each that follows a right
    one. ``width`` does not change the result. A list that holds most rows is many slices.
    """
    sliced = [*keys, "_slice"]
    rows = settle(readings.select(*keys, "screen_idx", "pos", "name", slice_of("screen_idx", width).alias("_slice")), "readings")
    slices = rows.groupBy(*sliced).agg(F.max("screen_idx").alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_slice")
    follows = slices.withColumn("_next", F.lead("_slice").over(order)).filter("_next is not null")
    nothing, no = F.array().cast("array<string>"), F.lit(False)
    before = (null_safe_join(rows, follows, sliced).filter("screen_idx = _last")
              .select(*keys, F.col("_next").alias("_slice"), F.lit(1).alias("turn"), "screen_idx", "pos", "name", no.alias("met"), F.lit(None).cast("array<string>").alias("recent")))
    names = rows.select(*sliced, "name").distinct()

    def met_before(put: DataFrame) -> DataFrame:
        """Which names of a slice were put on the list by an earlier one; ``put`` has (keys, name, slice) rows."""
        first = put.groupBy(*keys, "name").agg(F.min("_slice").alias("_put"))
        return null_safe_join(names, first, [*keys, "name"]).filter("_put < _slice").select(*sliced, "name")

    def replayed(starts: DataFrame, met: DataFrame, some: DataFrame | None) -> DataFrame:
        only = (lambda d: d) if some is None else (lambda d: null_safe_join(d, some, sliced, "left_semi"))
        own = null_safe_join(only(rows), met.withColumn("met", F.lit(True)), [*sliced, "name"], "left")
        own = own.select(*sliced, F.lit(2).alias("turn"), "screen_idx", "pos", "name", F.coalesce("met", no).alias("met"), F.lit(None).cast("array<string>").alias("recent"))
        head = only(starts).select(*sliced, F.lit(0).alias("turn"), F.lit(0).cast(rows.schema["screen_idx"].dataType).alias("screen_idx"),
                                   F.lit(0).cast(rows.schema["pos"].dataType).alias("pos"), F.lit("").alias("name"), no.alias("met"), "recent")
        return fold_sorted(own.unionAll(only(before)).unionAll(head), sliced, ["turn", "screen_idx", "pos"], lambda: _Piece(window),
                           f"{key_ddl(rows, sliced)}, what string, no int, name string, new int, recent array<string>")

    starts, met = slices.select(*sliced, nothing.alias("recent")), settle(met_before(names), "met")
    done = settle(replayed(starts, met, None), "replayed")
    while True:
        left = done.filter("what = 'state'").select(*sliced, F.coalesce(F.lag("recent").over(order), nothing).alias("recent"))
        now_starts, now_met = settle(left, "starts"), settle(met_before(done.filter("what = 'put'").select(*sliced, "name")), "met")
        other = null_safe_join(now_starts, starts.withColumnRenamed("recent", "_was"), sliced).filter("recent <> _was").select(*sliced)
        gone, come = (null_safe_join(a, b, [*sliced, "name"], "left_anti").select(*sliced) for a, b in ((met, now_met), (now_met, met)))
        changed = settle(other.unionAll(gone).unionAll(come).distinct(), "changed")
        if changed.isEmpty():
            break
        starts, met = now_starts, now_met
        kept = null_safe_join(done, changed, sliced, "left_anti")
        done = settle(kept.unionByName(replayed(starts, met, changed)), "replayed")
    sizes = done.filter("what = 'state'").select(*sliced, F.coalesce(F.sum("no").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = null_safe_join(done.filter("what = 'name'"), sizes, sliced).withColumn("no", (F.col("_start") + F.col("no")).cast("int"))
    # a later slice may have put a longer reading over one of the last names
    listed = placed.groupBy(*keys, "no").agg(F.max_by("name", "_slice").alias("name"))
    rounds = done.filter("what = 'round'").select(*keys, "what", "no", "name", "new")
    return listed.select(*keys, F.lit("name").alias("what"), "no", "name", F.lit(None).cast("int").alias("new")).unionAll(rounds)


class _FirstInBlock:
    """A block of names, then the names of a table in order: each name with the first whose reading it is. What has found one is compared no further."""

    STEP = 512

    def __init__(self):
        self.left, self.tokens, self.block = [], Tokens(), None

    def run(self, columns):
        turn, name, _ = columns
        asked = int((turn == 0).sum())
        self.left += name[:asked].tolist()
        out = ([], [])
        for s in range(asked, len(name), self.STEP):
            if not self.left:
                break
            if self.block is None:
                self.block = Block(self.left, self.tokens)
            table, found = Block(name[s:s + self.STEP].tolist(), self.tokens), {}
            for i, j in possible(self.block, table):
                for a, b in zip(i.tolist(), j.tolist()):
                    if a not in found and same_reading(self.left[a], table.names[b]):
                        found[a] = b
            if found:
                for a, b in found.items():
                    out[0].append(self.left[a])
                    out[1].append(table.names[b])
                self.left, self.block = [n for a, n in enumerate(self.left) if a not in found], None
        return list(out) if out[0] else None

    def end(self):
        return []


def _first_in_blocks(misses: DataFrame, table: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """(name, other): the first variant of each dense name among the dense names of ``table``, by ``_at`` of ``first``. A task has a block of names
    and walks the table of their list, which is copied once a block, until all have found theirs."""
    a = _in_blocks(misses, keys, "_blocks", 2 * BLOCK)
    b = table.filter("_dense").select(*keys, "name").join(first.select(*keys, "name", "_at").hint("merge"), [*keys, "name"])
    copies = _by_list(b, a.select(*keys, "_blocks").distinct(), keys).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"), F.lit(1).alias("_turn"), "name", "_at")
    rows = a.select(*keys, "_b", F.lit(0).alias("_turn"), "name", F.lit(None).cast(b.schema["_at"].dataType).alias("_at")).unionAll(copies)
    found = fold_sorted(rows, [*keys, "_b"], ["_turn", "_at", "name"], _FirstInBlock, f"{key_ddl(rows, [*keys, '_b'])}, name string, other string")
    return found.drop("_b")


class _FirstVariant:
    """The first of the names that come in order whose reading ``name``, the last key, is. Nothing behind it is compared."""

    keyed = True

    def __init__(self, key):
        self.name, self.found = key[-1], False

    def row(self, values):
        if self.found or not same_reading(self.name, values[-1]):
            return ()
        self.found = True
        return ((values[-1],),)

    def end(self):
        return ()


def resolve_exact_then_variant(names: DataFrame, table: DataFrame, keys: list[str], value: list[str],
                               order: str, variants: bool = True) -> DataFrame:
    """Look ``name`` up in ``table``: the exact name first; for misses the first variant by ``order``.
    ``matched`` is the name that was hit. Only misses enter the variant join."""
    cols = [F.col(c).alias(c) for c in value]
    # sized by its files a table looks small enough for a broadcast long after it is not
    hit = table.select(*keys, "name", F.col("name").alias("matched"), *cols).hint("merge")
    exact = names.join(hit, [*keys, "name"], "left")
    if not variants:
        return exact
    misses = names.join(table.select(*keys, "name").hint("merge"), [*keys, "name"], "left_anti")
    # structs, so that a row without an order comes first instead of being left out
    pick = F.min_by(F.struct(F.col("name").alias("matched"), *cols), F.struct(order))
    first = table.groupBy(*keys, "name").agg(F.min(F.struct(F.col(order).alias("at")))["at"].alias("_at"), pick.alias("_v"))
    l, r, crowded = _sides(misses, table.select(*keys, "name"), keys)
    at = first.select(*keys, F.col("name").alias("other"), "_at").hint("merge")
    near = _sparse_pairs(l, r, keys).join(at, [*keys, "other"])
    found = fold_sorted(near.select(*keys, "name", "_at", "other"), [*keys, "name"], ["_at", "other"], _FirstVariant, f"{key_ddl(near, [*keys, 'name'])}, other string")
    if crowded:
        found = found.unionByName(_first_in_blocks(l, r, first, keys)).join(at, [*keys, "other"])
        found = found.groupBy(*keys, "name").agg(F.min_by("other", F.struct("_at", "other")).alias("other"))
    found = found.join(first.select(*keys, F.col("name").alias("other"), "_v").hint("merge"), [*keys, "other"]).drop("other")
    out = exact.join(found, [*keys, "name"], "left")
    for c in ["matched", *value]:
        out = out.withColumn(c, F.coalesce(c, f"_v.{c}"))
    return out.drop("_v")


def resolve_stamp(names: DataFrame, stamps: DataFrame, keys: list[str], order: str = "pos",
                  variants: bool = True) -> DataFrame:
    """Stamp of each name, or of its first variant. A name whose own stamp is empty counts as a miss."""
    known = stamps.filter(F.col("stamp") != "")
    return resolve_exact_then_variant(names, known, keys, ["stamp"], order, variants)


def ledger_status(names: DataFrame, latest: DataFrame, keys: list[str], order: str = "pos",
                  variants: bool = True) -> DataFrame:
    """``status`` done or error from the latest ledger row of the name or its first variant, else NULL."""
    return resolve_exact_then_variant(names, latest, keys, ["status"], order, variants)


def only_matching(names: DataFrame, only: list[str], name: str = "name", variants: bool = True,
                  require: bool = True) -> DataFrame:
    """Names that equal, contain, are contained in, or are variants of a requested name.

    The request is a job parameter, so it becomes literals: no join. ``require`` raises if nothing matches. The native
    test comes first and only what it leaves reaches Python.
    """
    c = F.col(name)
    near = F.lit(False)
    for o in only:
        near = near | c.contains(o) | F.lit(o).contains(c)
    hits = names.filter(near)
    if variants:
        hits = hits.unionByName(names.filter(~near).filter(variant_of_any(c, only)))
    if require and hits.isEmpty():
        raise ValueError(f"no chat matches {only}")
    return hits


def best_match(targets: DataFrame, items: DataFrame, keys: list[str], order: str = "seq",
               variants: bool = True) -> DataFrame:
    """The item on a screen that means the target: equal or either-way substring first, then a variant;
    the first in order within a level. ``keys`` name the screen, whose items are few."""
    t = targets.withColumn("_t", F.regexp_replace("target", r"(?U)^\s+|\s+$", ""))
    pairs = t.join(items, keys)
    sub = F.col("name").contains(F.col("_t")) | F.col("_t").contains(F.col("name"))
    level = F.when(sub, 1)
    if variants:
        # the UDF sees only pairs the native test left open
        loose = (pairs.filter(~sub & (F.length(norm_name("_t")) >= 2)).filter(name_variant("_t", "name"))
                 .withColumn("level", F.lit(2)))
        pairs = pairs.filter(sub).withColumn("level", F.lit(1)).unionByName(loose)
    else:
        pairs = pairs.withColumn("level", level).filter("level is not null")
    best = F.min_by(F.struct("name", "level"), F.struct("level", order))
    return pairs.groupBy(*keys, "target").agg(best.alias("b")).select(
        *keys, "target", F.col("b.name").alias("name"), F.col("b.level").alias("level"))
