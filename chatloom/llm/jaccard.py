"""N-gram Jaccard join by universe partition and pigeonhole.

Two sets link if their Jaccard similarity is at least 3/4, that is, if their symmetric difference holds at most a seventh
of the sum of their sizes. The universe of shingles is parted into segments by hash, finely enough that linked
sets agree on some segment. Only candidates that agree on one are compared, exactly."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions.memo import remembered
from chatloom.llm.common import settle, small_enough
from chatloom.llm.grams import REMEMBERED, WordHashes, among, byte_words, frequent_grams, mixed, rolling
from chatloom.operators.entities import components

WIDTH = 5
#: Candidates up to which their ids are broadcast (8 bytes each), characters of text behind one bucket of signatures.
SMALL, BUCKET_CHARS = 1_000_000, 8_000_000
#: Size bands: a set is compared under the partition of the band of the larger set.
GROWTH = 1.5
#: Longs of a set's parity map.
PARITY = 16
#: Rounds in which the members of a segment meet one of them; after these all that are still apart meet.
STAR_ROUNDS = 2
#: Times that groups of one hub are taken together before that.
MERGES = 2


def shingle_set(words: list[bytes], hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one shingle, no words none."""
    if len(words) >= width:
        x = rolling(hashes.of(words), width)
        x.sort()
        return x[np.append(True, x[1:] != x[:-1])]
    if not words:
        return np.zeros(0, np.uint64)
    return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)


def set_key(tokens: np.ndarray) -> int:
    """Names a set. Sets are told apart by 64 bits: among N sets two are taken for one with odds N squared / 2**65."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


@remembered
def band(no: int) -> tuple[int, int]:
    """Range of set sizes, counted from the least size of the larger of two different sets that link."""
    lo = band(no - 1)[1] + 1 if no else 4
    return lo, max(lo, int(lo * GROWTH))


@partial(remembered, most=4096)
def bands(n: int) -> list[tuple[int, int, int]]:
    """(number, least, most) of the bands that a set of ``n`` has a part in: its own and those of larger partners."""
    out, no = [], 0
    while band(no)[0] <= 4 * n // 3:
        if band(no)[1] >= n:
            out.append((no, *band(no)))
        no += 1
    return out


@remembered
def segment_salts(no: int, m: int) -> np.ndarray:
    return mixed(np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(no))


@remembered
def allocation(lo: int, hi: int) -> tuple[int, bool]:
    """(segments, whether one-deletion neighbourhoods are used) of a band, whichever costs less.

    Sets of the band differ in at most h = 2 hi / 7 elements. Exact agreement: of more than h segments some agree.
    One-deletion neighbourhoods: of one segment with at most one difference, both sides list it whole and without each element.
    Exact segments with one element or none say little; each counts four times."""
    h = 2 * hi // 7
    segments = h + 1 + math.ceil(0.25 * (h + 1))
    load = lo / segments
    exact = (h + 1) * (1 + 4 * math.exp(-load) * (1 + load))
    return (1, True) if h <= 1 and 1 + lo < exact else (segments, False)


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Signatures of a set under its own band and those of larger sets it may link to; (band, agreements a partner implies).

    With m segments and at most h differences (which follow the set's own size), a linked set agrees on at least m - h
    segments. Cost decides what is listed: segments filled by frequent shingles alone and empty ones are left out, unless a linked set
    could agree on these only; then the frequent are listed too, at last the empty. Of a set that leaves both out, ``need`` =
    m - h - frequent - empty listed segments are listed by a linked set as well; of others at least one is."""
    n, out, needs = len(tokens), [], []
    common = among(tokens, frequent)
    common = common if common.any() else None
    for no, lo, hi in bands(n):
        m, deletions = allocation(lo, hi)
        h = mixed(tokens + np.uint64((no + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        if deletions:
            whole = h.sum(dtype=np.uint64)
            sig, need = mixed(np.concatenate([[whole], whole - h]) ^ np.uint64(no)), 1
        else:
            seg = ((h >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
            low = np.bincount(seg, (h & np.uint64(0xFFFFFFFF)).astype(np.float64), m).astype(np.uint64)
            high = np.bincount(seg, (h >> np.uint64(32)).astype(np.float64), m).astype(np.uint64)
            held = np.bincount(seg, minlength=m)
            agree, filled = m - (n + min(hi, 4 * n // 3)) // 7, held > 0
            plain = filled if common is None else filled & (np.bincount(seg, common, m) < held)
            # what isn't listed can't be all that a linked set agrees on
            for listed in (plain, filled, np.ones(m, bool)):
                need = agree - int(m - listed.sum())
                if need >= 1:
                    break
            need = need if listed is plain else 1
            sig = mixed((low + (high << np.uint64(32))) ^ segment_salts(no, m))[listed]
        # the band takes six bits of what travels of a signature
        out.append((sig & ~np.uint64(63 << 16)) | np.uint64(no << 16))
        needs.append((no, need))
    return out, needs


def _blocks(frames, chars: int = 1_000_000):
    """Lists of (id, text) that are worked on at once; ids are null if there are none."""
    for f in frames:
        rows, size = [], 0
        ids = f["doc_id"].astype("Int64").tolist() if "doc_id" in f else [None] * len(f)
        for i, t in zip(ids, f["text"].tolist()):
            rows.append((None if i is pd.NA else i, t))
            size += len(t or "")
            if size >= chars:
                yield rows
                rows, size = [], 0
        if rows:
            yield rows


def sketch(tokens: np.ndarray) -> bytes:
    """How many elements fall to each of 256 parts of the universe. Two sets differ by at least as much as their counts do."""
    return np.minimum(np.bincount((tokens >> np.uint64(40)).astype(np.int64) & 255, minlength=256), 255).astype(np.uint8).tobytes()


def parity(tokens: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITY parts of the universe: whether the set has an odd number of elements there. Every bit in which
    two sets differ is an element that only one of them has."""
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (64 * PARITY - 1), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_link(a: str, b: str) -> Column:
    """Whether sizes and parity maps leave room for a link: linked sets differ in at most a seventh of the sum of their sizes."""
    odd = sum((F.bit_count(F.col(f"p{a}")[i].bitwiseXOR(F.col(f"p{b}")[i])) for i in range(PARITY)), F.lit(0))
    return (odd * 7 <= F.col(f"n{a}") + F.col(f"n{b}")) & (F.col(f"n{a}") * 4 >= F.col(f"n{b}") * 3) & (F.col(f"n{b}") * 4 >= F.col(f"n{a}") * 3)


def segment_groups(docs: DataFrame, width: int, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Rows (gid, s, band, n, size): sets that agree on n listed segments of a bucket and how many these are, segments of the same members as
    one group. Beside them rows without gid: (s, band, n), on how many segments of a bucket a set meets others, or below zero how many it
    needs; and (s, doc_id, n, counts, odd), each text's set, its size, sketch and parity map, without band; s is null for an empty set.

    All travel packed: one row for each block of texts and bucket. Copies of a set within a task are listed once."""
    homes = max(1024, buckets)

    def cut(frames):
        hashes, known = WordHashes(), set()
        for rows in _blocks(frames):
            names, parts, ids, sets, needs = [], [], [], [], []
            if len(known) >= REMEMBERED:
                known.clear()
            for i, t in rows:
                x = shingle_set(byte_words(t, lower=True), hashes, width)
                s = set_key(x) if len(x) else 0
                ids.append((i or 0, i is not None, s, len(x)))
                sets.append(sketch(x) + parity(x).tobytes())
                if len(x) > 2 and s not in known:
                    known.add(s)
                    sigs, need = signatures(x, frequent)
                    names += [s] * len(sigs)
                    parts += sigs
                    needs += [(s, b, c) for b, c in need]
            home = xxhash.xxh3_64_intdigest(b"".join(sets)) % homes
            yield pd.DataFrame({"bucket": [-1 - home], "sigs": [np.array(ids, np.int64).tobytes()], "sets": [b"".join(sets)]})
            if not names:
                continue
            yield pd.DataFrame({"bucket": [-1 - homes - home], "sigs": [np.array(needs, np.int64).tobytes()], "sets": [b""]})
            sig, who = np.concatenate(parts), np.repeat(np.array(names, np.int64), [len(p) for p in parts])
            home = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            edges = np.flatnonzero(np.diff(home[order], prepend=-1))
            sig, who, home = sig[order], who[order], home[order]
            ends = np.append(edges[1:], len(sig))
            # six bytes of a signature beside its bucket are enough to tell segments apart; a chance meeting costs a comparison
            short = sig.view(np.uint8).reshape(-1, 8)[:, 2:]
            yield pd.DataFrame({"bucket": home[edges], "sigs": [short[a:b].tobytes() for a, b in zip(edges, ends)],
                                "sets": [who[a:b].tobytes() for a, b in zip(edges, ends)]})

    kinds = {"gid": "Int64", "s": "Int64", "band": "Int64", "n": "Int64", "size": "Int64", "doc_id": "Int64", "counts": object, "odd": object}
    record = 256 + 8 * PARITY

    def frame(size, /, **cols):
        return pd.DataFrame({c: pd.Series(cols.get(c, [None] * size), dtype=t) for c, t in kinds.items()})

    def meet(f):
        if f["bucket"].iloc[0] < -homes:
            need = np.unique(np.frombuffer(b"".join(f["sigs"]), np.int64).reshape(-1, 3), axis=0)
            return frame(len(need), s=need[:, 0], band=need[:, 1], n=-need[:, 2])
        if f["bucket"].iloc[0] < 0:
            told = np.frombuffer(b"".join(f["sigs"]), np.int64).reshape(-1, 4)
            kept = np.frombuffer(b"".join(f["sets"]), np.uint8).reshape(-1, record)
            named = lambda v, ok: pd.array(v, "Int64").copy() if ok.all() else pd.array(np.where(ok, v, 0), "Int64")
            doc, s = named(told[:, 0], told[:, 1] > 0), named(told[:, 2], told[:, 3] > 0)
            doc[told[:, 1] == 0], s[told[:, 3] == 0] = pd.NA, pd.NA
            return frame(len(told), s=s, doc_id=doc, n=told[:, 3], counts=[x[:256].tobytes() for x in kept],
                         odd=[x[256:].copy().view(np.int64) for x in kept])
        whole = np.zeros((sum(map(len, f["sigs"])) // 6, 8), np.uint8)
        whole[:, :6] = np.frombuffer(b"".join(f["sigs"]), np.uint8).reshape(-1, 6)
        sig, who = whole.view(np.uint64).ravel(), np.frombuffer(b"".join(f["sets"]), np.int64)
        order = np.lexsort((who, sig))
        sig, who = sig[order], who[order]
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (who[1:] != who[:-1]))
        sig, who = sig[fresh], who[fresh]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        count = np.diff(np.append(start, len(sig)))
        several = np.repeat(count > 1, count)
        if not several.any():
            return frame(0)
        band_of = (sig & np.uint64(63)).astype(np.int64)
        gid = mixed(np.add.reduceat(mixed(who.view(np.uint64)), start) + mixed(count.astype(np.uint64) << np.uint64(6) | band_of[start].astype(np.uint64)))
        # how many segments of a set others list as well: its bucket's share of what it needs
        met = pd.DataFrame({"s": who[several], "band": band_of[several]}).groupby(["s", "band"]).size().reset_index(name="n")
        _, one, alike = np.unique(gid, return_index=True, return_counts=True)
        pick, times = np.zeros(len(start), bool), np.zeros(len(start), np.int64)
        pick[one], times[one] = True, alike
        rows = np.repeat(pick & (count > 1), count)
        shared = frame(len(met), s=met["s"], band=met["band"], n=met["n"])
        return pd.concat([shared, frame(int(rows.sum()), gid=np.repeat(gid, count)[rows].astype(np.int64), s=who[rows], band=band_of[rows],
                                        n=np.repeat(times, count)[rows], size=np.repeat(count, count)[rows])], ignore_index=True)

    return (docs.select("doc_id", "text").mapInPandas(cut, "bucket long, sigs binary, sets binary")
            .groupBy("bucket").applyInPandas(meet, "gid long, s long, band long, n long, size long, doc_id long, counts binary, odd array<long>"))


@F.pandas_udf(T.IntegerType())
def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    """By how much two sketches differ."""
    x, y = (np.frombuffer(b"".join(z), np.uint8).reshape(-1, 256).astype(np.int16) for z in (a, b))
    return pd.Series(np.abs(x - y).sum(1).astype(np.int32))


@F.pandas_udf(T.BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.concatenate([x, y])
        both.sort()
        n = int((both[1:] == both[:-1]).sum())
        return 100 * n >= 75 * (len(x) + len(y) - n)
    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)


def _fetched(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(s, tokens): the whole sets of the documents ``ids``. Up to SMALL ids are broadcast to the texts."""
    def fetch(frames):
        hashes = WordHashes()
        for rows in _blocks(frames):
            sets = [x for x in (shingle_set(byte_words(t, lower=True), hashes, width) for _, t in rows) if len(x)]
            yield pd.DataFrame({"s": pd.array([set_key(x) for x in sets], "int64"), "tokens": pd.Series([x.tobytes() for x in sets], dtype=object)})

    chosen = docs.filter("doc_id is not null").join(small_enough(ids, SMALL), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    return chosen.select("text").mapInPandas(fetch, "s long, tokens binary").groupBy("s").agg(F.first("tokens").alias("tokens"))


def _verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (u, v) that link. Sizes and sketches rule out most others exactly; the sets of the rest are fetched and compared."""
    side = lambda k: known.select(F.col("s").alias(k), F.col("n").alias(f"n{k}"), F.col("counts").alias(f"c{k}"), F.col("doc_id").alias(f"d{k}"))
    near = (F.col("nu") * 4 >= F.col("nv") * 3) & (F.col("nv") * 4 >= F.col("nu") * 3)
    likely = pairs.join(side("u"), "u").join(side("v"), "v").filter(near)
    likely = settle(likely.filter(_apart("cu", "cv") * 7 <= F.col("nu") + F.col("nv")).select("u", "v", "du", "dv"), "likely")
    ids = likely.select(F.col("du").alias("doc_id")).union(likely.select("dv")).filter("doc_id is not null").distinct()
    sets = settle(_fetched(docs, settle(ids, "fetch"), width), "tokens")
    joined = (likely.select("u", "v").join(sets.select(F.col("s").alias("u"), F.col("tokens").alias("tu")), "u")
              .join(sets.select(F.col("s").alias("v"), F.col("tokens").alias("tv")), "v"))
    return settle(joined.filter(_linked("tu", "tv")).select("u", "v"), "links")


def as_one(groups: DataFrame, salt: int) -> DataFrame:
    """``groups`` (gid, s, root) with those of one hub, the member with the least hash, as one group, where together they have no more pairs
    than one by one. Similar sets share dozens of segments: they meet once instead of in each. No pair that shares a group is lost."""
    hubs = settle(groups.groupBy("gid").agg(F.min_by("s", F.xxhash64("s", F.lit(salt))).alias("hub"), F.count("*").cast("double").alias("n")), "hubs")
    together = groups.join(hubs, "gid").select("hub", "s").distinct().groupBy("hub").agg(F.count("*").cast("double").alias("all"))
    apart = hubs.groupBy("hub").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    pays = together.join(apart, "hub").filter("all * all <= pairs").select("hub", F.col("hub").alias("one"))
    named = hubs.join(pays, "hub", "left").select("gid", F.coalesce("one", "gid").alias("one"))
    return settle(groups.join(named, "gid").select(F.col("one").alias("gid"), "s", "root").distinct(), "together")


def link_components(groups: DataFrame, known: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(s, root): components of the links among sets that share a group.

    A group's members first meet one of them, then another one. Whoever is linked by then is settled; members of a group
    that are still apart meet one another, so that no link between components is missed. Before that, groups of much the same members become one."""
    spark = groups.sparkSession
    nodes = settle(groups.select(F.col("s").alias("id")).distinct(), "nodes")
    root = nodes.select("id", F.col("id").alias("root"))
    links = spark.createDataFrame([], "u long, v long")
    left = groups
    for turn in range(STAR_ROUNDS + 1):
        member = left.join(root.withColumnRenamed("id", "s"), "s")
        split = member.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("s", F.xxhash64("s", F.lit(turn))).alias("hub"),
                                          F.min_by("root", F.xxhash64("s", F.lit(turn))).alias("hub_root")).filter("lo <> hi")
        left = settle(member.join(split.select("gid", "hub", "hub_root"), "gid").select("gid", "s", "root", "hub", "hub_root"), "apart")
        if turn < STAR_ROUNDS:
            pairs = left.filter("root <> hub_root").select(F.least("s", "hub").alias("u"), F.greatest("s", "hub").alias("v"))
        else:
            for salt in range(1, 1 + MERGES):
                left = as_one(left.select("gid", "s", "root"), -salt)
            sized = left.join(known.select("s", "n", "odd"), "s")
            a = sized.select("gid", F.col("s").alias("u"), F.col("root").alias("ru"), F.col("n").alias("nu"), F.col("odd").alias("pu"))
            b = sized.select("gid", F.col("s").alias("v"), F.col("root").alias("rv"), F.col("n").alias("nv"), F.col("odd").alias("pv"))
            pairs = a.join(b, "gid").filter(F.expr("ru < rv") & _may_link("u", "v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        found = _verified(pairs.distinct(), known, docs, width)
        left = left.select("gid", "s")
        if found.isEmpty():
            continue
        links = links.unionByName(found)
        root = settle(components(nodes, links), "roots")
    return root.withColumnRenamed("id", "s")


def similar_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Null or blank text: an empty set, linked with nothing. component_id is the least id that links lead to, the row's own
    included; null ids count for nothing unless there are no others. Equal texts and repeated rows share a set, which travels and is
    compared once. No rows give no rows. Extra columns are ignored.
    Sets that meet others on fewer segments than any link implies are out before anything is compared, and of the others' segments
    only the rarest are used, as many as they have beyond that. Hot groups: segments that frequent shingles fill are left
    out where that is safe, groups shrink to the members still apart, and parity maps are compared inside the join."""
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    frequent = frequent_grams(docs, width, lower=True)
    met = settle(segment_groups(docs, width, max(128, chars // BUCKET_CHARS), frequent), "segments")
    rows = met.filter("gid is null and band is null").select("doc_id", "n", "s", "counts", "odd")
    able = met.filter("gid is null and band is not null").groupBy("s", "band").agg(
        F.sum(F.greatest("n", F.lit(0))).alias("met"), F.max(-F.least("n", F.lit(0))).alias("need")).filter("met >= need")
    # linked sets share at least as many segments as either needs, so the first that they share, the rarest first, is not among the last need - 1 of either
    shared = met.filter("gid is not null").groupBy("gid", "s", "band").agg(F.sum("n").alias("n"), F.max("size").alias("size")).join(able, ["s", "band"])
    before = F.sum("n").over(Window.partitionBy("s", "band").orderBy("size", "gid").rowsBetween(Window.unboundedPreceding, -1))
    groups = shared.withColumn("before", F.coalesce(before, F.lit(0))).filter("before <= met - need").select("gid", "s")
    groups = settle(groups, "members")
    groups = settle(groups.join(groups.groupBy("gid").count().filter("count > 1").select("gid"), "gid", "left_semi"), "groups")
    wanted = rows.filter("s is not null").join(groups.select("s").distinct(), "s", "left_semi")
    known = settle(wanted.groupBy("s").agg(F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("odd").alias("odd"), F.min("doc_id").alias("doc_id")), "known")
    root = link_components(groups, known, docs, width)
    least = rows.filter("s is not null").groupBy("s").agg(F.min("doc_id").alias("doc_id"))
    least = least.join(root, "s", "left").select("s", F.coalesce("root", "s").alias("root"), "doc_id")
    named = settle(least.join(least.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("s", "component_id"), "named")
    # an empty set links with nothing and must not meet the other empty sets in one task
    empty = rows.filter("s is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = rows.filter("s is not null").join(named, "s").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(empty)


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that with the least id. Texts without words stay.

    Rows are told apart by id and text, so one id may name several texts. Rows of one id that have one text stay once; a row
    without an id goes if it is similar to a row with one, and of similar rows without ids one stays."""
    # the hash stands for the row's id: linked groups come back by it, the least id is chosen here
    row = F.xxhash64("doc_id", "text")
    ids = docs.select(row.alias("r"), "doc_id").distinct()
    grouped = settle(similar_groups(docs.select(row.alias("doc_id"), "text"), width).withColumnRenamed("doc_id", "r").join(ids, "r"), "grouped")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r"))["r"].alias("stays")
    first = grouped.groupBy("component_id").agg(least)
    drop = grouped.join(first, "component_id").filter("r <> stays").select(F.col("r").alias("_one_of_each")).distinct()
    keyed = docs.withColumn("_one_of_each", row)
    kept = keyed.join(small_enough(settle(drop, "drop"), SMALL), "_one_of_each", "left_anti")
    twice = settle(grouped.filter("n_shingles > 0").groupBy("r").count().filter("count > 1").select(F.col("r").alias("_one_of_each")), "twice")
    if twice.isEmpty():
        return kept.drop("_one_of_each")
    again = kept.join(small_enough(twice, SMALL), "_one_of_each", "left_semi").dropDuplicates(["_one_of_each"])
    return kept.join(small_enough(twice, SMALL), "_one_of_each", "left_anti").unionByName(again).drop("_one_of_each")
