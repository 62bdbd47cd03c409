"""License notices that stand word for word are found, whatever repeats beside them."""

import random


def test_notices_are_found_among_repeated_grams(spark):
    from chatloom.llm.licenses import TEMPLATES, _parts, scan

    r = random.Random(4)
    docs, want = [(0, "released under the mit license " + "the mit license mit license " * 6)], {0: [(0, 5, "mit")]}
    for n, (name, text) in enumerate(TEMPLATES.items(), 1):
        words = _parts(text)
        stray = lambda: [w for _ in range(12) for a in [r.randrange(len(words) - 2)] for w in words[a:a + 2]]
        before = stray() + ["pause"] * 9
        docs.append((n, " ".join(before + words + ["pause"] * 9 + stray())))
        want[n] = [(len(before), len(before) + len(words), name.removesuffix("-notice"))]
        docs.append((n + 100, " ".join(stray() + words + stray())))
    docs += [(200, None), (201, ""), (202, "the license you may not use")]
    got = {x["row"]["doc_id"]: x["spans"] for x in scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, spans in want.items():
        assert all(any(s["start"] <= a and s["stop"] >= b and s["label"] == label and s["share"] == 1 for s in got[i]) for a, b, label in spans), (i, got[i])
    for i, text in docs:
        if 100 < i < 200:
            label = list(TEMPLATES)[i - 101].removesuffix("-notice")
            assert any(s["label"] == label and s["share"] == 1 for s in got[i]), (i, got[i])
    assert got[200] == got[201] == got[202] == []
