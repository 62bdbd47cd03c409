"""Operators against plain models: given tables in full, and small random texts that are rich in ties and copies."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import queries as q

SCHEMA = "doc_id long, text string"


def texts_of(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def invented(seed, n=60):
    """Short and long texts over few words, with copies, near copies, shared passages and blanks."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "ß", "THE", "the", "cc", "by", "all", "rights", "reserved", "token=abcdefgh12"]
    passage = [r.choice(vocab) for _ in range(70)]
    docs = []
    for i in range(n):
        kind = r.random()
        words = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 7, 8, 9, 12, 40, 60, 120, 200]))]
        if docs and kind < 0.15:
            text = r.choice(docs)[1]
        elif docs and kind < 0.5:
            words = (r.choice(docs)[1] or "").split()
            for _ in range(r.choice([1, 1, 2, 4])):
                if words:
                    at = r.randrange(len(words))
                    words[at:at + r.randint(0, 1)] = [r.choice(vocab)]
            text = " ".join(words)
        elif kind < 0.65:
            at = r.randint(0, len(words))
            text = " ".join(words[:at] + passage[r.randint(0, 10):r.randint(55, 70)] + words[at:])
        else:
            text = r.choice([" ", "\n", "\t "]).join(words)
        docs.append((i, text))
    r.shuffle(docs)
    return [(i, None if i == 7 else t) for i, t in docs]


@pytest.mark.parametrize("name, model, columns", [
    ("op1_secret_scan", brute.base_secrets, ["n_assign", "n_access", "n_hex", "base_sha256"]),
    ("op2_quality_rules", brute.quality_base, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]),
    ("op3_license_scan", brute.license_base, ["n_words", "n_base", "first_word", "last_word", "base_labels"]),
])
def test_per_document(spark, data, name, model, columns):
    texts = texts_of(spark, data)
    rows = q.QUERIES[name](spark, data).select("doc_id", *columns).collect()
    assert len(rows) == len(texts)
    assert [r for r in rows if tuple(r)[1:] != tuple(model(texts[r["doc_id"]]))] == []


def test_components_of_the_given_table(spark, data):
    want = brute.similar_components(list(texts_of(spark, data).items()))
    got = {r[0]: tuple(r)[1:] for r in q.QUERIES["op6_jaccard_join"](spark, data).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == want


def test_repeats_of_the_given_table(spark, data):
    want = brute.repeats_removed(list(texts_of(spark, data).items()))
    got = {r[0]: tuple(r)[1:] for r in q.QUERIES["op7_substring_dedup"](spark, data).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_invented_texts(spark, seed):
    from chatloom.llm.jaccard import similar_groups

    docs = invented(seed)
    got = {r[0]: (r[1], r[2]) for r in similar_groups(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()}
    assert got == brute.similar_components(docs)


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats_of_invented_texts(spark, seed):
    from chatloom.llm.superkmer import remove_repeats

    docs = invented(seed)
    d = remove_repeats(spark.createDataFrame(docs, SCHEMA).repartition(4))
    got = {r[0]: tuple(r)[1:] for r in d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()}
    assert got == brute.repeats_removed(docs)


def test_signatures_lose_no_link():
    """Any two different sets at 3/4 or more share the signatures that each needs, whatever counts as frequent."""
    from chatloom.llm.jaccard import signatures

    r = np.random.default_rng(1)
    for _ in range(1500):
        n = int(r.integers(3, 160))
        common = r.integers(0, 2**64, n, dtype=np.uint64)
        x = common[r.random(n) > 0.12 * r.random()]
        y = common[r.random(n) > 0.12 * r.random()]
        x, y = (np.unique(np.append(z, r.integers(0, 2**64, int(r.integers(0, 1 + n // 12)), dtype=np.uint64))) for z in (x, y))
        both = len(np.intersect1d(x, y))
        frequent = np.sort(common[: n // 2])
        if (len(x), len(y)) != (both, both) and 100 * both >= 75 * (len(x) + len(y) - both):
            (a, needs), (b, _) = signatures(x, frequent), signatures(y, frequent)
            met = [(np.isin(p, np.concatenate(b)).sum(), need) for p, (_, need) in zip(a, needs)]
            assert any(n >= need for n, need in met), (len(x), len(y), both)


def test_automaton_equals_edit_distance():
    from chatloom.llm.toxicity import Automaton

    def distance(x, y):
        d = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            p, d[0] = d[0], i
            for j, e in enumerate(y, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (c != e))
        return d[-1]

    terms = ["loser", "closer", "idiot", "pathetic", "scum", "worthless", "worth"]
    a, r = Automaton(terms), random.Random(2)
    for _ in range(4000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w) + 1)
            w[at:at + r.randint(0, 1)] = r.choice(["", "a", "o", "s", "l"])
        w = "".join(w)
        assert a.match(w) == min(((distance(w, t), t) for t in terms if distance(w, t) <= a.allowed(t)), default=None)


def test_weak_parts_need_their_complement(spark):
    """The interval join against trying every pair of parts."""
    from chatloom.llm.secrets import BASE, COMPLEMENTS, REACH, ROLE, find_parts, secret_digest

    r = random.Random(5)
    parts = ["user = alice", "login: bob77", "https://db.example.com/x", "host=db1.local", "pwd: hunter22", "password = abcd", "secret=abcdefgh99", "AKIA" + "Q" * 16, "f" * 32, "\n\n", "Zz9" + "aB3" * 12 + "x"]
    docs = [(i, "".join(r.choice(parts) + " " * r.choice([1, 5, 50, 390, 900]) for _ in range(r.randint(1, 12)))) for i in range(150)]
    got = {x["doc_id"]: x["spans"] for x in secret_digest(spark.createDataFrame(docs, SCHEMA)).collect()}
    for i, t in docs:
        p = find_parts(t)
        keep = [x for x in p if x[0] in BASE or any(ROLE[y[0]] in COMPLEMENTS[ROLE[x[0]]] and y[3] == x[3] and abs(x[1] - y[1]) <= REACH for y in p)]
        assert got[i] == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in keep), t


def test_mix_meets_its_targets(spark, data):
    rows = q.QUERIES["op5_mixing"](spark, data).collect()
    again = q.QUERIES["op5_mixing"](spark, data).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    texts = texts_of(spark, data)
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(brute.words(t)) for i, t in texts.items()}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(r["size"] for r in rows if r["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    full, target = set(), {}
    while True:  # as the contract says it: share, cap, share the excess again
        free = [s for s in sources if s not in full]
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in sources}
        above = {s for s in free if target[s] > 2 * size[s]}
        if not above:
            break
        full |= above
    for s in sources:
        mine = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and r["source_size"] == size[s] and r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(r["size"] for r in mine)


def test_mix_by_tree_keeps_totals(spark):
    """Many small documents, a small fan-in: several levels of the tree, and each source within one document of its target."""
    from chatloom.llm.mixing import mix

    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.least(F.col("id") % 7, F.lit(3)).cast("string")).alias("source"),
                                    F.repeat(F.lit("a "), (F.col("id") % 37 + 1).cast("int")).alias("text"))
    rows = mix(docs, fan_in=16).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.countDistinct("copies").alias("c")).collect()
    assert all(abs(r["t"] - r["w"]) <= 37 for r in rows)


def test_benchmark_passages_are_found(spark, data):
    norm = lambda t: " ".join((t or "").lower().split())
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts_of(spark, data).items() for k, b in items.items() if b in norm(t)}
    got = {(r["doc_id"], r["item_id"]) for r in q.QUERIES["op8_benchmark_decontamination"](spark, data).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(got) + 1


def test_paraphrases_are_found_and_other_texts_left_alone(spark):
    from chatloom.llm.decontaminate import leaks

    r = random.Random(11)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    vocab = [word() for _ in range(900)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(30))) for k in range(20)]
    docs, want = [], set()
    for k, t in items:
        w = t.split()
        for at in r.sample(range(20), 5):  # five words of the first part are others
            w[at] = r.choice(vocab)
        docs.append((k, " ".join(say(r.randint(0, 200)) + w + say(r.randint(0, 200)))))
        want.add((k, k))
    docs += [(100 + i, " ".join(say(300))) for i in range(60)]
    got = {(x["doc_id"], x["item_id"]) for x in leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 18 and not got - want


@pytest.mark.parametrize("name, label", [("op4_toxicity", "toxic"), ("op10_quality_classifier", "quality")])
def test_held_out_accuracy(spark, name, label):
    big = "/root/testdata/sf0.01"
    rows = (q.QUERIES[name](spark, big).join(spark.read.parquet(f"{big}/labels.parquet").filter(F.col(label).isNotNull()), "doc_id").filter("held_out")
            .select(label, "predicted", "score").collect())
    assert len(rows) > 50 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r[label] == r["predicted"] for r in rows) >= 0.9 * len(rows)


def test_pages_give_their_article(spark):
    from chatloom.llm.html import extract

    page = ('<html><head><title>t</title><script>var x="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy &amp; sell</div>'
            '<div class="content"><article><h1>A  title</h1><p>First &lt;b&gt; para\n graph with <b>bold</b> text and more of it.</p><div class="share-box">Share</div><ul><li>one</li><li>two</li></ul></article>'
            '<section class="comments"><p>{}</p></section></div><form><p>Your mail</p></form><footer>&copy; host</footer></body></html>')
    rows = [(i, f"http://h.example/{i}", page.format("A reader writes a long comment here. " * (i % 3))) for i in range(6)]
    rows += [(6, None, "<p>only"), (7, "http://h.example/7", None), (8, "http://h.example/8", "")]
    got = {r["row"]["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "A title\nFirst <b> para graph with bold text and more of it.\none\ntwo"
    assert got == {**{i: want for i in range(6)}, 6: "only", 7: "", 8: ""}


LAYOUT = ['<body class="has-sidebar">{}</body>', '<body><div id="page" class="no-ads">{}</div></body>', '<body><article class="post comments-open">{}</article></body>',
          '<body><main class="search-results">{}</main></body>', '<html class="menu"><body id="search" role="banner"><div class="sidebar">{}</div></body></html>',
          '<body><svg viewBox="0 0 1 1" />{}</body>', "<body><iframe src='x'/>{}<iframe></iframe></body>", "<body><svg/>{}<svg><text>no</text></svg></body>"]


@pytest.mark.parametrize("page", LAYOUT)
def test_marks_of_the_layout_drop_no_text(page):
    from chatloom.llm.html import blocks_of, main_text

    text = "Words of the article that stand on the page, enough of them to be its text."
    inner = f'<p>{text}</p><div class="ad-slot">Buy</div><div class="site-footer">End</div><div class="Related">More</div><script src=/a/b/>no</script>'
    assert main_text(blocks_of(page.format(inner)), None) == text


def test_long_comments_beside_an_article_stay_out():
    from chatloom.llm.html import blocks_of

    page = "<body><div class='wrap'><article><p>The article is short but it is the text of this page.</p></article><section class='comments'>{}</section></div></body>"
    assert len(blocks_of(page.format("<p>A comment that is quite long and says little about it.</p>" * 5))) == 1


def test_all_unlabelled_documents_take_part(spark):
    """The fit over Spark's sums is that over every row of a pool with more sure rows than a round used to exchange."""
    import numpy as np

    from chatloom.llm import cotrain
    from chatloom.llm.toxicity import fit_logistic

    r = random.Random(11)
    good = lambda: " ".join(r.choice(["the", "of", "and", "house", "river", "walked", "because"]) + r.choice(["", "s"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY", "###", "now!!!", "$$$"]) for _ in range(r.randint(3, 12)))
    rows, marks = [], []
    for i in range(5400):
        y = r.random() < 0.5
        rows.append((i, good() if y else bad(), "en", f"s{r.randint(0, 3) + 4 * (y if r.random() < 0.97 else not y)}", 300 if y else 30))
        if i < 400:
            marks.append((i, int(y if r.random() < 0.99 else not y)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(marks, "doc_id long, quality int")
    table = cotrain.featured(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    known = cotrain._views(table[:400])
    pool = cotrain._views(table[400:])
    y, w = np.array([m[1] for m in marks], float), {k: fit_logistic(x[:, :-1], np.array([m[1] for m in marks], float)) for k, x in known.items()}
    past = [{k: (w[k], np.array([4.0, 0.0])) for k in w}]
    given = cotrain._given(pool, past)
    assert all((v == 1).sum() > 2000 and (v == 0).sum() > 2000 for v in given.values())
    frame = cotrain.featured(docs.filter("doc_id >= 400")).drop("doc_id")
    got = cotrain._fit(known, y, frame.repartition(5), past, w)
    for k, x in known.items():
        use = ~np.isnan(given[k])
        s = np.concatenate([np.ones(400), np.full(use.sum(), cotrain.TRUST)])
        want = fit_logistic(np.concatenate([x, pool[k][use]])[:, :-1], np.concatenate([y, given[k][use]]), s)
        assert np.allclose(got[k], want, atol=1e-4)
    assert {r["predicted"] for r in cotrain.quality_scores(docs, labels).collect()} == {0, 1}


def test_an_id_counts_once_in_the_fit(spark):
    """Many rows of one labelled id weigh as one."""
    from chatloom.llm.cotrain import quality_scores

    rows = [(i, " ".join(["the river"] * (i % 7 + 5)) if i % 2 else "### $$$ BUY", "en", "a", 50) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    score = lambda rs: {r["doc_id"]: round(r["score"], 6) for r in quality_scores(spark.createDataFrame(rs, "doc_id long, text string, lang string, source string, n_chars long"), labels).collect()}
    assert score(rows) == score(rows + [rows[1]] * 300)
