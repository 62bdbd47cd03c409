"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, columns with clashing names."""

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 9000}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa token = abcdefgh1234 all rights reserved", "en", "a", 90),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa token = abcdefgh1234 all rights reserved", "en", "a", 90),
    (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t", "en", None, 3), (None, "no id at all but some words here", "de", "b", None),
    (None, None, None, None, None), (5, LONG, "en", "a", len(LONG)), (6, LONG, "en", "b", len(LONG)), (7, "x", "fr", "b", 1), (8, "\u0000 \U0001f600 É", "fr", "b", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHING = ["row", "_text", "_key", "_words", "n_words", "kept", "k", "s", "h", "gid", "bucket", "size", "target", "copies", "y", "score", "quality", "spans", "_leaks", "host", "path", "mini", "item_id", "word", "no", "f"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, 0), (3, 0, 1), (None, 1, 1), (7, 0, None), (8, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "gamma delta epsilon zeta eta theta iota"), (1, None), (None, "x y z"), (2, ""), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string")


def operators():
    from chatloom.llm import cotrain, decontaminate, jaccard, licenses, mixing, quality, secrets, superkmer, toxicity

    return {
        "secrets": lambda d, l, b: secrets.secret_digest(d), "mask": lambda d, l, b: secrets.mask_secrets(d),
        "quality": lambda d, l, b: quality.judge(d), "licenses": lambda d, l, b: licenses.license_digest(d),
        "toxicity": lambda d, l, b: toxicity.toxicity(d, l), "mix": lambda d, l, b: mixing.mix(d),
        "jaccard": lambda d, l, b: jaccard.similar_groups(d), "repeats": lambda d, l, b: superkmer.remove_repeats(d),
        "leaks": lambda d, l, b: decontaminate.with_leaks(d.select("doc_id", "text"), b), "cotrain": lambda d, l, b: cotrain.quality_scores(d, l),
    }


NAMES = ["secrets", "mask", "quality", "licenses", "toxicity", "mix", "jaccard", "repeats", "leaks", "cotrain"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, labels, benchmark, name):
    """A row for a row; rows that are the same get the same."""
    rows = operators()[name](docs, labels, benchmark).collect()
    assert len(rows) == len(ROWS)
    ids = [r["row"]["doc_id"] if "row" in r and hasattr(r["row"], "doc_id") else r["doc_id"] for r in rows]
    assert sorted(map(str, ids)) == sorted(str(r[0]) for r in ROWS)
    if name != "mix":
        assert len({str(r) for r, i in zip(rows, ids) if i == 1}) == 1


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, labels, benchmark, name):
    assert operators()[name](docs.limit(0), labels, benchmark).collect() == []
    assert len(operators()[name](docs, labels.limit(0), benchmark.limit(0)).collect()) == len(ROWS)


def test_known_values(docs, labels, benchmark):
    ops = operators()
    same = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ops["jaccard"](docs, labels, benchmark).collect()}
    assert {(5, 9000, 5), (6, 9000, 5), (2, 0, 2), (3, 0, 3), (7, 1, 7)} <= same
    gone = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in ops["repeats"](docs, labels, benchmark).collect()}
    assert gone[5] == (60_000, 0) and gone[6] == (60_000, 60_000) and gone[2] == gone[3] == (0, 0)
    hits = {(r["doc_id"], h["item_id"]) for r in ops["leaks"](docs, labels, benchmark).collect() for h in r["_leaks"]}
    assert {(1, 1), (5, 3), (6, 3)} <= hits
    masked = [r["text"] for r in ops["mask"](docs, labels, benchmark).collect() if r["doc_id"] == 1]
    assert all("[assign]" in t and "abcdefgh1234" not in t for t in masked)
    taken = [r for r in ops["mix"](docs, labels, benchmark).collect()]
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2) for r in taken)


def test_one_of_each(docs):
    from chatloom.llm.jaccard import one_of_each

    kept = one_of_each(docs)
    assert set(docs.columns) == set(kept.columns)
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "4", "5", "7", "8", "None", "None"])


def test_pages(spark):
    from chatloom.llm.html import extract

    pages = spark.createDataFrame([(None, None, None), (1, "", ""), (2, "http://a/x", "<p>x" * 30_000), (2, "http://a/x", "<p>x" * 30_000), (3, "nonsense", "<div")], "page_id long, url string, html string")
    pages = pages.withColumn("host", F.lit(1)).withColumn("path", F.lit(2)).withColumn("text", F.lit(3))
    assert sorted(len(r["text"]) for r in extract(pages).collect()) == [0, 0, 0, 59_999, 59_999]
    assert extract(pages.limit(0)).collect() == []


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    d = spark.createDataFrame(ROWS, SCHEMA)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such words anywhere in here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (d, d.limit(0), d.withColumns({c: F.lit(1) for c in CLASHING})):
            out = stage(spark, rows, str(tmp_path))
            assert set(SCHEMA.replace(",", "").split()[::2]) <= set(out.columns)
            assert out.count() <= rows.count()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} <= {1, 5, None, 8}


def test_document_frequencies_are_those_of_all_texts(spark):
    import numpy as np

    from chatloom.llm.decontaminate import fit_space

    docs = spark.createDataFrame([(i, f"alpha w{i} " + "beta " * (i % 3 == 0)) for i in range(2500)], "doc_id long, text string")
    space = fit_space(docs, [(1, "alpha beta gamma delta epsilon")], sample=50)
    df = np.array([{b"alpha": 2500, b"beta": 834}.get(w, 0) for w in sorted(space.known)])
    assert np.allclose(space.idf, np.log(2501 / (1 + df)) + 0.05)


def test_one_of_each_by_id_and_text(spark):
    from chatloom.llm.jaccard import one_of_each

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (None, a + " end"), (None, "x " + " ".join(f"z{i}" for i in range(40))), (None, " ".join(f"z{i}" for i in range(40)))]
    kept = [tuple(r) for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {r for r in kept if r[0]} == {(1, a), (2, b), (3, c), (3, d)}
    assert len(kept) == 5 and "z39" in next(t for i, t in kept if i is None)


def test_an_id_counts_once_in_toxicity(spark):
    from chatloom.llm.toxicity import toxicity

    rows = [(i, "you are an idiot" if i % 2 else "the river is wide") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    score = lambda rs: {r["doc_id"]: round(r["score"], 9) for r in toxicity(spark.createDataFrame(rs, "doc_id long, text string"), labels).collect()}
    assert score(rows) == score(rows + [rows[1]] * 300)


def test_the_latent_space_is_fitted_on_all_texts(spark, monkeypatch):
    """More texts than the fit once took: every passage is in the sums of each power step."""
    import numpy as np

    from chatloom.llm import decontaminate as dc

    docs = spark.createDataFrame([(i, "alpha beta gamma" if i % 2 else "delta epsilon") for i in range(2500)] + [(9999, None)], "doc_id long, text string")
    known = {w: n for n, w in enumerate([b"alpha", b"beta", b"delta", b"epsilon", b"gamma"])}
    sums, real = [], dc._gram_product
    monkeypatch.setattr(dc, "_gram_product", lambda cut, idf, q: sums.append((cut.agg({"n": "sum"}).first()[0], real(cut, idf, q), idf, q)) or sums[-1][1])
    dc.fit_space(docs, [(1, "alpha beta gamma delta epsilon")])
    assert [n for n, *_ in sums] == [2500] * dc.STEPS
    _, got, idf, q = sums[0]
    a = np.array([[1, 1, 0, 0, 1]] * 1250 + [[0, 0, 1, 1, 0]] * 1250) * idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert np.allclose(got, a.T @ (a @ q)) and set(known) == {b"alpha", b"beta", b"gamma", b"delta", b"epsilon"}
