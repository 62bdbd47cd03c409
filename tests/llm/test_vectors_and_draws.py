"""Clustering, exact search and resampling against plain models, on tables rich in ties, copies and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def vectors(seed, n=300, dims=64):
    """Few distinct values, a vector that a third of the rows share, and rows that must stay out."""
    r = random.Random(seed)
    hot = [r.choice([-0.25, 0.0, 0.125]) for _ in range(dims)]
    rows = []
    for i in range(n):
        x = list(hot) if i % 3 == 0 else [r.choice([-1.0, -0.3, 0.0, 0.01, 0.5, 2.0]) if r.random() < 0.2 else r.gauss(0, 0.2) for _ in range(dims)]
        rows.append((i, x))
    rows += [(7, rows[7][1]), (None, rows[8][1]), (None, rows[9][1]), (1001, None), (1002, []), (1020, [0.5] * (dims - 1)), (1040, [0.5] * (dims + 1)),
             (1060, [NAN] + [0.5] * (dims - 1)), (1061, [INF] + [0.5] * (dims - 1)), (1080, [None] + [0.5] * (dims - 1)), (1100, [0.0] * dims)]
    r.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("row", "v", "no", "id", "cluster", "place", "x")})


def floors(x, scale):
    return [math.floor(scale * float(np.float32(c))) for c in x]


def finite(x):
    return x is not None and all(c is not None and math.isfinite(c) for c in x)


def clustered(rows, k, rounds):
    v = [(i, floors(x, 256)) for i, x in rows if finite(x) and len(x) == 64]
    packed = lambda x: np.array(x, "<i4").tobytes()
    start = sorted(v, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), packed(r[1])))[:k]
    c = [list(x) for _, x in start]
    for no in range(rounds + 1):
        at = [min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for _, x in v]
        for j in range(len(c)):
            mine = [x for (_, x), (_, a) in zip(v, at) if a == j]
            if mine and no < rounds:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    per = Counter()
    for d, j in at:
        per[j] += d
    return sorted((str(i), j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(v, at))


@pytest.mark.parametrize("seed, k, bits", [(1, 12, 6), (2, 5, 2), (3, 1, 4)])
def test_clusters(spark, seed, k, bits):
    from chatloom.llm.centroids import centroid_digest, cluster_vectors

    rows = vectors(seed)
    d = cluster_vectors(table(spark, rows).repartition(5), k=k, bits=bits)
    got = d.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_digest("centroid")).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == clustered(rows, k, 5)


def test_few_or_no_vectors_to_cluster(spark):
    from chatloom.llm.centroids import cluster_vectors

    rows = vectors(4, 10)
    assert {r["distance"] for r in cluster_vectors(table(spark, rows)).collect()} == {0}
    none = cluster_vectors(table(spark, rows).limit(0))
    assert none.collect() == [] and none.columns == cluster_vectors(table(spark, rows)).columns


def test_intervals_hold_and_sure_vectors_need_no_fetch(spark):
    """Well separated groups: cells alone decide; the true nearest centroid is always among the possible."""
    from chatloom.llm.cells import Cells
    from chatloom.llm.centroids import Lookup

    r = np.random.default_rng(5)
    middles = r.integers(-2000, 2000, (6, 16))
    x = middles[r.integers(0, 6, 3000)] + r.integers(-40, 40, (3000, 16))
    for bits in (1, 3, 6):
        cells = Cells(x[:500], x.min(0), x.max(0), bits)
        codes = cells.codes(x)
        assert (cells.unpacked(cells.packed(codes)) == codes).all()
        low, high = cells.bounds(codes)
        assert (low <= x).all() and (x <= high).all()
        possible = Lookup(cells, middles).possible(codes)
        exact = ((x[:, None] - middles) ** 2).sum(2)
        assert possible[np.arange(3000), exact.argmin(1)].all()
        if bits == 6:
            assert (possible.sum(1) == 1).mean() > 0.99


def searched(rows, k, every):
    good = [(i, floors(x, 64)) for i, x in rows if finite(x)]
    good = sorted({(i, tuple(x)) for i, x in good}, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for i, x in good:
        if i is not None and i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), j is None, j or 0, j) for j, y in good if j != i)[:k]
            out += [(i, place, j, -s) for place, (s, _, _, j) in enumerate(best, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("seed, k, every, bits, block, query_block", [(1, 20, 20, 6, 4096, 1024), (2, 3, 7, 2, 50, 9), (3, 400, 50, 4, 100, 3)])
def test_search(spark, seed, k, every, bits, block, query_block):
    from chatloom.llm.topk import top_products

    rows = vectors(seed)
    got = top_products(table(spark, rows).repartition(5), k=k, every=every, bits=bits, block=block, query_block=query_block).collect()
    assert sorted(str(tuple(r)) for r in got) == searched(rows, k, every)


def test_search_without_queries_or_others(spark):
    from chatloom.llm.topk import top_products

    rows = [(20, [0.5, 1.0]), (None, None)]
    assert top_products(table(spark, rows)).collect() == []
    assert top_products(table(spark, [(1, [0.5]), (None, [0.5])])).collect() == []
    assert top_products(table(spark, rows).limit(0)).collect() == []
    assert [tuple(r) for r in top_products(table(spark, [*rows, (3, [1e30, -1.0, 1.0])])).collect()] == [(20, 1, 3, 32 * 2 ** 24 - 64 * 64)]


def test_the_search_query_counts_every_row(spark, tmp_path):
    """Rows that come twice, and rows of one id with other vectors, are candidates of each other and queries of their own."""
    from chatloom.llm.queries import QUERIES

    rows = vectors(9)
    rows += [r for r in rows if r[0] is not None and r[0] % 3 != 1][:120] + [(20, [0.9] * 64), (40, [-0.5] * 64), (None, [0.8] * 64)]
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    good = [(i, floors(x, 64)) for i, x in rows if finite(x)]
    want = []
    for n, (i, x) in enumerate(good):
        if i is not None and i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), j is None, j or 0, j) for m, (j, y) in enumerate(good) if m != n)[:20]
            want += [(i, place, j, -s) for place, (s, _, _, j) in enumerate(best, 1)]
    got = QUERIES["op12_exact_topk"](spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def drawn(docs, target, percent=10, least=20, longest=1, buckets=10000, seed=2024):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def runs(t):
        w = WORD.findall((t or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    d, t = [(i, *runs(x)) for i, x in docs], Counter(b for x in target for b in runs(x)[1])
    s = Counter(b for _, _, f in d for b in f)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, n, f in d:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    enough = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(enough[:percent * len(enough) // 100], 1):
        r[4] = place
    return rows


def corpus(seed, n=400):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)] + ["É", "Straße", "THE", "the", "x-y", "漢字", "\U0001f600"]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(r.choice([0, 1, 19, 20, 21, 60, 200])))) for i in range(n)]
    docs += [(None, docs[5][1]), (n, None), (n + 1, ""), (n + 2, "\x00 -- \x7f"), (n + 3, " ".join(vocab) * 900)]
    return docs, [" ".join(r.choice(vocab[:9]) for _ in range(30)) for _ in range(40)] + [None, ""]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"percent": 37, "longest": 3, "buckets": 97}), (3, {"percent": 100, "least_words": 1})])
def test_draw(spark, seed, options):
    from chatloom.llm.resample import importance_sample

    docs, target = corpus(seed)
    names = {"percent": "percent", "least_words": "least", "longest": "longest", "buckets": "buckets"}
    want = drawn(docs, target, **{names[k]: v for k, v in options.items()})
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "rank", "tie", "no", "neg", "piece", "n_words")})
    got = importance_sample(d.repartition(6), spark.createDataFrame([(x,) for x in target], "text string"), **options)
    assert sorted(str((r["row"]["doc_id"], *tuple(r)[1:])) for r in got.collect()) == sorted(str(tuple(r[:5])) for r in want)


def test_draw_among_repeated_rows(spark):
    """One id a third of the rows, every row alike: exactly the share is drawn, ranks run through."""
    from chatloom.llm.resample import importance_sample

    text = " ".join(f"a{i}" for i in range(25))
    rows = [(5, text)] * 3000 + [(i, text) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = importance_sample(d, d.limit(0), percent=30).collect()
    assert len(got) == 5000 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1501))
    order = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert all((-x["score"], x["row"]["doc_id"]) <= (-y["score"], y["row"]["doc_id"]) for x, y in zip(order, order[1:]))
    edge = (-order[-1]["score"], order[-1]["row"]["doc_id"])
    assert all((-r["score"], r["row"]["doc_id"]) >= edge for r in got if not r["rank"])


@pytest.mark.parametrize("docs", [[], [(1, "too short")], [(None, None)]])
def test_nothing_to_draw(spark, docs):
    from chatloom.llm.resample import importance_sample

    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r["rank"] for r in importance_sample(d, d).collect()] == [None] * len(docs)


def test_cutoff_is_exact(spark):
    from chatloom.llm.resample import cutoff, within

    r = random.Random(9)
    rows = [(r.choice([-2 ** 62, -5, 0, 3, 2 ** 62]), r.randint(0, 4), i) for i in range(300)]
    d = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, 2, 57, 150, 299, 300):
        got = sorted(tuple(x) for x in d.filter(within(cutoff(d, ["a", "b", "c"], k))).collect())
        assert got == sorted(rows)[:k]
