"""How often work is done."""

import itertools
import random


def test_groups_of_one_hub_are_one_group_and_lose_no_pair(spark):
    from chatloom.llm.jaccard import as_one

    r = random.Random(5)
    groups = {f: set(r.sample(range(f // 40 * 100, f // 40 * 100 + 30), 27)) for f in range(120)}
    # one member in all of these, which otherwise have nothing in common: together they would be 901 members
    groups |= {1000 + k: {7, *range(5000 + 10 * k, 5010 + 10 * k)} for k in range(90)}
    rows = [(g, s, s) for g, members in groups.items() for s in members]
    left = spark.createDataFrame(rows, "gid long, s long, root long")
    for salt in (-1, -2):
        left = as_one(left, salt)
    got = {}
    for x in left.collect():
        assert x["root"] == x["s"]
        got.setdefault(x["gid"], []).append(x["s"])
    pairs = lambda sets: {p for m in sets for p in itertools.combinations(sorted(m), 2)}
    cost = lambda sets: sum(len(m) ** 2 for m in sets)
    assert pairs(groups.values()) <= pairs(got.values())
    assert cost(got.values()) < cost(groups.values()) / 4
    assert max(map(len, got.values())) < 200


def test_members_of_many_segments_meet_about_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from chatloom.llm import jaccard

    merge, cost = jaccard.as_one, []

    def tried(groups):
        return groups.groupBy("gid").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]

    def counted(groups, salt):
        out = merge(groups, salt)
        cost.append((tried(groups), tried(out)))
        return out

    monkeypatch.setattr(jaccard, "as_one", counted)
    # seven tenths of each text are shared: many segments in common, no link
    shared = [f"s{i}" for i in range(300)]
    texts = [" ".join(shared + [f"u{k}y{i}" for i in range(90)]) for k in range(40)]
    got = jaccard.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["component_id"]) for x in got} == {(i, i) for i in range(40)}
    assert len(cost) == jaccard.MERGES and cost[-1][1] * 5 <= cost[0][0], cost


def test_a_text_is_searched_for_secrets_once(spark, monkeypatch):
    from chatloom.llm import secrets

    plans, settle = [], secrets.settle

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, label)

    monkeypatch.setattr(secrets, "settle", seen)
    rows = [(1, "password = abcd1234efgh"), (1, "password = abcd1234efgh"), (2, "nothing"), (3, None), (None, "é token: 0123456789abcdef\n\nuser = bob")]
    got = secrets.secret_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x["doc_id"]), x["n_assign"], x["spans"]) for x in got) == [
        ("1", 1, "assign:0:23"), ("1", 1, "assign:0:23"), ("2", 0, ""), ("3", 0, ""), ("None", 1, "assign:2:25")]
    # one pass of Python on each branch that reads the texts
    assert plans[0].count("ArrowEvalPython") + plans[0].count("MapInArrow") == plans[0].count("Scan ExistingRDD")
