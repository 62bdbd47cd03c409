"""Decontamination: texts are cut once, and what is ruled out before a verdict could not have passed it."""

import random

import numpy as np

from chatloom.llm import decontaminate as dc


def numbered(texts, known):
    return [np.array([known.get(w.strip(dc.STRIP), -1) for w in t.lower().encode().split()], "<i2").tobytes() for t in texts]


def space_of(items, rank=8):
    ids, words = dc.item_words(items)
    known = dc._known(words)
    numbers = [np.array([known[x] for x in w]) for w in words]
    idf = np.random.default_rng(1).uniform(0.5, 3.0, len(known))
    own = np.zeros((len(ids), len(known)))
    for i, v in enumerate(numbers):
        own[i, np.unique(v)] = idf[np.unique(v)]
    directions = np.linalg.svd(own, full_matrices=False)[2].T[:, :rank].astype(np.float32)
    places = (own @ directions).astype(np.float32)
    places /= np.linalg.norm(places, axis=1, keepdims=True) + 1e-9
    return dc.Space(ids, numbers, known, idf, directions * idf[:, None].astype(np.float32), places, (own ** 2).sum(1))


def plain_hits(cell, space, search):
    """Passage by passage and item by item, every one that is close gets a verdict."""
    v, best = np.frombuffer(cell, "<i2").astype(int), {}
    starts = sorted({*range(0, max(len(v) - dc.PASSAGE, 0), dc.STRIDE), max(len(v) - dc.PASSAGE, 0)}) if len(v) else []
    for s in starts:
        inside = v[s:s + dc.PASSAGE]
        inside = inside[inside >= 0]
        if (space.idf[inside] ** 2).sum() < dc.MASS * space.mass.min():
            continue
        place = space.directions[np.unique(inside)].sum(0)
        place = place / (np.linalg.norm(place) + 1e-9)
        for i, c in enumerate(space.places @ place):
            n = len(space.words[i])
            if c >= dc.COSINE and best.get(i, (0, 0.0, 0.0))[1] < 1.0:
                share = search.verdict(i, v[max(0, s - n):s + dc.PASSAGE + n].tolist())
                if share and (share, c) > best.get(i, (0, 0.0, 0.0))[1:]:
                    best[i] = (s, share, c)
    return [(space.items[i], s, round(float(c), 4), share) for i, (s, share, c) in sorted(best.items())]


def test_the_search_finds_what_a_plain_one_finds():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(r.choices(vocab, k=r.choice([5, 12, 30, 45])))) for k in range(12)]
    space = space_of(items)
    search = dc.Search(space)
    texts = ["", "   ", "nothing known here", "w1"]
    for k, t in items:
        w = t.split()
        for at in r.sample(range(len(w)), len(w) // 5):
            w[at] = r.choice([*vocab, "other"])
        texts.append(" ".join(r.choices([*vocab, "x", "y"], k=r.randint(0, 150)) + w + r.choices([*vocab, "x", "y"], k=r.randint(0, 150))))
    texts += [items[2][1].upper() + ".", " ".join(r.choices(vocab, k=5000))]
    cells = numbered(texts, space.known)
    got = [[(i, s, round(c, 4), share) for i, s, c, share in h] for h in dc.find_hits(cells, search)]
    assert got == [plain_hits(c, space, search) for c in cells]
    assert sum(map(len, got)) > 10 and got[:4] == [[]] * 4
    # one text alone or among others, in blocks of few passages: the same
    assert [h for c in cells for h in dc.find_hits([c], search)] == dc.find_hits(cells, search) == dc.find_hits(cells, search, most=3)


def test_passages_of_the_fit_hold_their_distinct_words():
    r = np.random.default_rng(2)
    texts = [r.integers(-1, 9, n).astype("<i2") for n in (0, 1, 31, 32, 33, 64, 200, 3000)]
    want = [np.unique(p[p >= 0]).tolist() for t in texts for p in np.split(t, range(dc.PASSAGE, len(t), dc.PASSAGE)) if len(p)]
    got = []
    for rows, cols, n in dc._read([{"_numbers": [t.tobytes() for t in texts]}], "<i2", most=7):
        got += [cols[rows == k].tolist() for k in range(n)]
    assert got == want


def test_texts_are_cut_once(spark):
    """The search reads the numbers that the fit has read; it doesn't cut the texts a second time, nor do they travel with the numbers."""
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None)], "doc_id long, text string")
    found = dc.leaks(docs, spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta")], "item_id long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_numbers" in plan and "text#" not in plan
    assert [(x["doc_id"], x["item_id"], x["start"], x["common"]) for x in found.collect()] == [(1, 7, 0, 1.0)]
