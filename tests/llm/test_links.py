"""Families of near copies about the threshold: no link may be lost to the bounds that keep pairs few."""

import random

import brute
import numpy as np
import pytest


def family(r, no, n, length, edits):
    vocab = [f"v{no}x{i}" for i in range(3000)]
    origin = [r.choice(vocab) for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(origin)
        for at in r.sample(range(length), r.randint(0, edits)):
            w[at] = r.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed, length, edits", [(1, 12, 2), (2, 60, 8), (3, 200, 14), (4, 420, 26)])
def test_components_of_families(spark, seed, length, edits):
    from chatloom.llm.jaccard import similar_groups

    r = random.Random(seed)
    texts = [t for no in range(6) for t in family(r, no, 25, length + 3 * no, edits)]
    shared = " ".join(f"s{i}" for i in range(length // 3))
    texts += [f"{shared} " + " ".join(f"u{k}y{i}" for i in range(length)) for k in range(30)]
    docs = list(enumerate(texts))
    got = {x[0]: (x[1], x[2]) for x in similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.similar_components(docs)


def test_parity_maps_are_a_lower_bound():
    from chatloom.llm.jaccard import parity

    r = np.random.default_rng(3)
    for n in (1, 30, 500, 5000):
        x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.append(x[r.random(len(x)) > 0.2], r.integers(0, 2**64, n // 10, dtype=np.uint64)))
        differ = sum(int(v).bit_count() for v in (parity(x) ^ parity(y)).view(np.uint64))
        assert differ <= len(np.setxor1d(x, y))
