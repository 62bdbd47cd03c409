import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chatloom.functions import grid
from chatloom.functions import similarity as sim
from chatloom.functions.memo import remembered
from chatloom.functions.text import norm_name
from chatloom.operators import entities as en


@pytest.mark.parametrize("a,b", [("赵嫣嫣AI事务所", "赵景煨AI事务所"), ("钧棋13674969", "匀棋13674969937"),
                                 ("优视光近视", "尤视光近视防控护眼灯郑将军"), ("赵A事务所", "赵嫣嫣AI事务所")])
def test_variants(a, b):
    assert sim.same_reading(a, b) and sim.same_reading(b, a)


@pytest.mark.parametrize("a,b", [("黄春健", "黄春徤"), ("钧棋13674969", "李四13800138000"), ("李四", "王李四丰工程部通知群"), ("", "黄春健")])
def test_no_variants(a, b):
    assert not sim.same_reading(a, b)


def random_names(rng, n):
    base = ["".join(rng.choice("abcdeАБ赵钱孙李") for _ in range(rng.randint(3, 12))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        s = list(rng.choice(base))
        how = rng.randint(0, 4)
        if how == 0:
            s.pop(rng.randrange(len(s)))
        elif how == 1:
            s[rng.randrange(len(s))] = rng.choice("xyz孙")
        elif how == 2:
            s += rng.choices("pqr12", k=rng.randint(1, 7))
        elif how == 3:
            s += list(str(rng.choice([13674969, 136749690, 1367496])))
        else:
            s.insert(rng.randrange(len(s)), rng.choice(" ·-"))
        out.append("".join(s))
    return list(dict.fromkeys(x for x in out if x))


def test_blocking_loses_no_pair(spark):
    rng = random.Random(11)
    lists = {k: random_names(rng, 90) for k in ("a", "b")}
    df = spark.createDataFrame([(k, n) for k, ns in lists.items() for n in ns], "list_id string, name string")
    got = {tuple(r) for r in en.variant_pairs(df, None, ["list_id"]).collect()}
    want = {(k, x, y) for k, ns in lists.items() for x in ns for y in ns if x != y and sim.same_reading(x, y)}
    assert want and got == want


def test_blocking_between_two_tables(spark):
    rng = random.Random(12)
    xs = random_names(rng, 120)
    left, right = xs[::2], xs[1::2]
    mk = lambda ns: spark.createDataFrame([(n,) for n in ns], "name string")
    got = {tuple(r) for r in en.variant_pairs(mk(left), mk(right)).collect()}
    assert got == {(x, y) for x in left for y in right if x != y and sim.same_reading(x, y)}


def test_components(spark):
    rng = random.Random(13)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    ids = [*range(300), *range(1000, 1041)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = {r.id: r.root for r in en.components(nodes, spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: min(j for j in ids if find(j) == find(i)) for i in ids}


def test_groups_are_components_of_the_variant_graph(spark):
    rng = random.Random(17)
    lists = {"a": random_names(rng, 90), "b": random_names(rng, 60)}
    df = spark.createDataFrame([(k, n) for k, ns in lists.items() for n in ns], "list_id string, name string")
    got = {}
    for r in en.variant_groups(df, ["list_id"]).collect():
        got.setdefault((r.list_id, r.root), set()).add(r["name"])
    want = set()
    for k, ns in lists.items():
        left = set(ns)
        while left:
            group, grow = set(), {left.pop()}
            while grow:
                group |= grow
                grow = {y for y in left if any(sim.same_reading(x, y) or sim.same_reading(y, x) for x in grow)}
                left -= grow
            want.add(frozenset(group))
    assert {frozenset(g) for g in got.values()} == want and len(got) == len(want)


def greedy(names):
    longest = {}        # position of the first reading -> longest reading
    for pos, name in enumerate(names):
        homes = [lead for lead, rep in longest.items() if rep == name or sim.same_reading(name, rep)]
        lead = homes[0] if homes else pos
        longest[lead] = max(longest.get(lead, ""), name, key=len)
    return list(longest.values())


def test_dedupe(spark):
    rng = random.Random(14)
    lists = {"x": ["赵A事务所", "黄春健", "赵嫣嫣AI事务所"], "y": ["黄春健", "黄春雅", "大有咨询王博"], "z": random_names(rng, 100)}
    df = spark.createDataFrame([(k, i, n) for k, ns in lists.items() for i, n in enumerate(ns)], "list_id string, pos bigint, name string")
    out = en.dedupe_names(df, ["list_id"]).orderBy("list_id", "pos").collect()
    got = {k: [r.name for r in out if r.list_id == k] for k in lists}
    assert got["x"] == ["赵嫣嫣AI事务所", "黄春健"] and got["y"] == lists["y"]
    assert got == {k: greedy(ns) for k, ns in lists.items()}


def rounds(screens, window):
    """The running union without state objects: everything is looked up afresh."""
    found, ever, per_screen = [], [], []
    for no, screen in enumerate(screens):
        previous = screens[no - 1] if no else []
        size = len(found)
        for name in screen:
            if name in ever or name in previous or [p for p in previous if sim.same_reading(name, p)]:
                continue
            like = [i for i, f in enumerate(found) if i >= len(found) - window and sim.same_reading(name, f)]
            if not like:
                found.append(name)
            elif len(name) > len(found[like[0]]):
                found[like[0]] = name
            else:
                continue
            ever.append(name)
        per_screen.append(len(found) - size)
    return found, per_screen


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_merge_rounds(spark, width):
    rng = random.Random(15)
    pool = random_names(rng, 60)
    lists = {k: [rng.sample(pool, 6) for _ in range(12)] for k in ("a", None)}
    lists["c"] = [["赵A事务所", "黄春健"], ["黄春健", "赵嫣嫣AI事务所"], ["新群"]]
    rows = [(k, 3 * s, i, n) for k, ss in lists.items() for s, ns in enumerate(ss) for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "list_id string, screen_idx int, pos int, name string")
    out = en.merge_round_names(df, ["list_id"], 8, width).collect()
    for k, screens in lists.items():
        names, new = rounds(screens, 8)
        mine = sorted((r for r in out if r.list_id == k), key=lambda r: r.no)
        assert [r.name for r in mine if r.what == "name"] == names
        assert [(r.no, r.new) for r in mine if r.what == "round"] == [(3 * s, n) for s, n in enumerate(new)]


def test_a_long_list_is_many_slices(spark):
    """A list with most of the rows, whose names come again and again far apart, against the walk in one piece."""
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(90)]
    rows = [("l", s, i, n + rng.choice(["", "", "q", "zz"])) for s in range(120) for i, n in enumerate(rng.sample(pool, 4))]
    df = spark.createDataFrame(rows, "list_id string, screen_idx int, pos int, name string").repartition(6)
    whole, cut = (sorted(map(str, en.merge_round_names(df, ["list_id"], 16, w).collect())) for w in (10_000, 9))
    assert cut == whole


def test_native_forms_agree(spark):
    rng = random.Random(16)
    names = random_names(rng, 70)
    pairs = [(a, b) for a in names for b in rng.sample(names, 15)]
    df = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", sim.is_subseq_drop("a", "b").alias("d"), sim.shared_digit_run("a", "b").alias("n"), norm_name("a").alias("na"))
    for r in df.collect():
        assert r.d == sim.subseq_drop(r.a, r.b), (r.a, r.b)
        assert r.n == sim.numbers_agree(r.a, r.b), (r.a, r.b)


def test_lookup_exact_then_variant(spark):
    names = spark.createDataFrame([("2028届八年级1",), ("黄春健",), ("无关的名字",)], "name string")
    table = spark.createDataFrame([("2028届八年级14班", "done", 1), ("黄春健", "error", 2), ("2028届八年级15班", "error", 3)],
                                  "name string, status string, pos int")
    got = {r.name: (r.matched, r.status) for r in en.ledger_status(names, table, []).collect()}
    assert got == {"2028届八年级1": ("2028届八年级14班", "done"), "黄春健": ("黄春健", "error"), "无关的名字": (None, None)}


def test_empty_stamp_is_a_miss(spark):
    names = spark.createDataFrame([("赵嫣嫣AI事务所",)], "name string")
    stamps = spark.createDataFrame([("赵嫣嫣AI事务所", "", 1), ("赵A事务所", "昨天", 2)], "name string, stamp string, pos int")
    assert en.resolve_stamp(names, stamps, []).first().stamp == "昨天"


def test_only_matching(spark):
    names = spark.createDataFrame([("黄藏寺项目值班值守",), ("赵嫣嫣AI事务所",), ("别的群",)], "name string")
    assert {r.name for r in en.only_matching(names, ["黄藏寺项目值班", "赵A事务所"]).collect()} == {"黄藏寺项目值班值守", "赵嫣嫣AI事务所"}
    with pytest.raises(ValueError):
        en.only_matching(names, ["完全没有"])


def test_best_match(spark):
    items = spark.createDataFrame([(1, 1, "赵景煨AI事务所"), (1, 2, "黄春健(工作)"), (1, 3, "黄春健")], "screen int, seq int, name string")
    targets = spark.createDataFrame([(1, "黄春健"), (1, "赵嫣嫣AI事务所"), (1, "没有这个人")], "screen int, target string")
    got = {r.target: (r.name, r.level) for r in en.best_match(targets, items, ["screen"]).collect()}
    assert got == {"黄春健": ("黄春健(工作)", 1), "赵嫣嫣AI事务所": ("赵景煨AI事务所", 2)}


def test_families_go_on_where_code_points_end(spark):
    """Later families borrow characters of earlier ones, and are still variants of nobody else."""
    from chatloom.plans import family_queries as fq

    some = [0, 1, 2, 3, 7, fq.OWN - 1, fq.OWN, fq.OWN + 1, fq.OWN + 5, 2 * fq.OWN, 2 * fq.OWN + 3, 3 * fq.OWN - 1]
    names = fq._families(spark.createDataFrame([(3 * f + i,) for f in some for i in range(3)], "c_custkey long"))
    rows = names.collect()
    assert len({r["name"] for r in rows}) == len(rows)
    assert all(r["base"] == "".join(chr(fq.FIRST + r["family"] * 8 + j) for j in range(8)) for r in rows if r["family"] < fq.OWN)
    assert any(set(a["base"]) & set(b["base"]) for a in rows for b in rows if a["family"] < b["family"])
    got = {tuple(r) for r in en.variant_pairs(names, None, ["list_id"]).select("name", "other").collect()}
    assert got == {(a["name"], b["name"]) for a in rows for b in rows if a["family"] == b["family"] and a["name"] != b["name"]}


def test_first_variant_is_compared_until_found(spark):
    """Lists stay apart, a row without an order comes first, and names behind the first variant are not compared."""
    table = [("a", "项目沟通群一", 5, "x"), ("a", "项目沟通群二", None, "y"), ("a", "项目沟通群三", 1, "z"), ("b", "项目沟通群三", 0, "w"), ("b", "项目沟通群三", 4, "v")]
    asked = spark.createDataFrame([("a", "项目沟通群四"), ("b", "项目沟通群四"), ("b", "别的")], "list_id string, name string")
    stamps = spark.createDataFrame(table, "list_id string, name string, pos long, stamp string")
    got = {(r["list_id"], r["name"], r["matched"], r["stamp"]) for r in en.resolve_stamp(asked, stamps, ["list_id"]).collect()}
    assert got == {("a", "项目沟通群四", "项目沟通群二", "y"), ("b", "项目沟通群四", "项目沟通群三", "w"), ("b", "别的", None, None)}
    calls = []
    fold, real = en._FirstVariant(("a", "项目沟通群四")), en.same_reading
    en.same_reading = lambda *x: calls.append(x) or real(*x)
    try:
        assert [list(fold.row((i, n))) for i, n in enumerate(["别的", "项目沟通群一", "项目沟通群二"])] == [[], [("项目沟通群一",)], []]
    finally:
        en.same_reading = real
    assert len(calls) == 2


def test_no_side_of_the_name_join_is_broadcast(spark):
    names = spark.createDataFrame([("l", f"聊天{i}群{i * 7}") for i in range(50)], "list_id string, name string")
    plan = en.candidate_pairs(names, None, ["list_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_workers_need_no_copy_of_the_package(tmp_path):
    """What a task runs is read by a process that cannot import the package, as on an executor."""
    jaccard = pytest.importorskip("chatloom.llm.jaccard")
    sim.same_reading("甲乙丙丁", "甲乙丙丁戊")      # what the driver remembers stays with it
    (tmp_path / "task").write_bytes(cloudpickle.dumps((sim.same_reading, jaccard.signatures, sim._plain)))
    code = """
import pickle, sys
import numpy as np
same, signatures, plain = pickle.load(open("task", "rb"))
print(len(plain.known), same("abcdefgh", "abcqefgh"), same("abcdefgh", "stuvwxyz"))
print(sum(len(s) for s in signatures(np.arange(40, dtype=np.uint64) << np.uint64(50), np.zeros(0, np.uint64))[0]))
print("chatloom" in sys.modules)
"""
    out = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    here = sum(len(s) for s in jaccard.signatures(np.arange(40, dtype=np.uint64) << np.uint64(50), np.zeros(0, np.uint64))[0])
    assert out.stdout.split("\n")[:3] == ["0 True False", str(here), "False"], out.stderr


def test_remembered_results_are_bounded():
    calls = []
    f = remembered(lambda x: calls.append(x) or x * 2, 2)
    assert [f(1), f(1), f(2), f(3), f(1)] == [2, 2, 4, 6, 2] and calls == [1, 2, 3, 1] and len(f.known) <= 2


@pytest.fixture(params=["all", "some"])
def crowded(request, monkeypatch):
    """Names under a key of four compared in blocks of seven: all of a list, or those under such keys."""
    monkeypatch.setattr(en, "CROWDED", 4)
    monkeypatch.setattr(en, "BLOCK", 7)
    monkeypatch.setattr(en, "PER_MEETING", {"all": 1e9, "some": 1.5}[request.param])
    return request.param


def test_crowded_names_lose_no_pair(spark, crowded):
    rng = random.Random(31)
    lists = {"a": random_names(rng, 80), "b": random_names(rng, 60), "c": ["赵嫣嫣AI事务所", "赵A事务所"]}
    lists["a"] += [f"项目{i:03d}群136749{i:03d}" for i in range(12)] + ["", "·", "q"]
    lists["a"] += ["".join(chr(0x5000 + i * 7 + j) for j in range(7)) for i in range(90)]
    df = spark.createDataFrame([(k, n) for k, ns in lists.items() for n in ns] + [(None, "abc"), (None, "abcd")], "list_id string, name string")
    want = {(k, x, y) for k, ns in lists.items() for x in ns for y in ns if x != y and sim.same_reading(x, y)}
    got = [tuple(r) for r in en.variant_pairs(df, None, ["list_id"]).collect()]
    assert set(got) == want and len(got) == len(want)
    (l,) = en._tokenised([df], ["list_id"])
    dense = {r[0]: r[1] for r in l.filter("_dense").groupBy("list_id").count().collect()}
    assert {"all": dense.get("a") == len(lists["a"]), "some": 0 < dense.get("a", 0) < len(lists["a"])}[crowded], dense
    # without lists, between two tables
    xs = lists["a"]
    mk = lambda ns: spark.createDataFrame([(n,) for n in ns], "name string")
    got = [tuple(r) for r in en.variant_pairs(mk(xs[::2]), mk(xs[1::2])).collect()]
    assert sorted(got) == sorted((x, y) for x in xs[::2] for y in xs[1::2] if sim.same_reading(x, y))
    possible = {tuple(r) for r in en.candidate_pairs(df, None, ["list_id"]).collect()}
    assert possible >= want and possible == {(k, y, x) for k, x, y in possible}


def test_crowded_names_are_grouped_as_before(spark, crowded):
    rng = random.Random(32)
    lists = {"a": random_names(rng, 90) + ["".join(chr(0x5000 + i * 7 + j) for j in range(7 + i % 2)) for i in range(90)], "z": random_names(rng, 50)}
    df = spark.createDataFrame([(k, i, n) for k, ns in lists.items() for i, n in enumerate(ns)], "list_id string, pos bigint, name string")
    out = en.dedupe_names(df, ["list_id"]).orderBy("list_id", "pos").collect()
    assert {k: [r.name for r in out if r.list_id == k] for k in lists} == {k: greedy(ns) for k, ns in lists.items()}


def test_crowded_names_find_their_first_variant(spark, crowded):
    rng = random.Random(33)
    xs = random_names(rng, 150) + ["".join(chr(0x5000 + i * 7 + j) for j in range(7 + i % 2)) for i in range(90)]
    asked, known = xs[::2], [(n, None if i == 40 else (i * 37) % 101) for i, n in enumerate(xs[1::2])]
    names = spark.createDataFrame([(7, n) for n in asked], "list_id int, name string")
    table = spark.createDataFrame([(7, n, p, f"s{n}") for n, p in known], "list_id int, name string, pos int, stamp string")
    got = {r["name"]: (r["matched"], r["stamp"]) for r in en.resolve_stamp(names, table, ["list_id"]).collect()}
    order = sorted(known, key=lambda x: (x[1] is not None, x[1], x[0].encode()))
    want = {a: next(((n, f"s{n}") for n, _ in order if sim.same_reading(a, n)), (None, None)) for a in asked}
    assert got == want


def test_many_clusters_are_searched_through_a_shelf(monkeypatch):
    rng = random.Random(34)
    names = random_names(rng, 260) + [f"编号{i}{i:06d}" for i in range(30)]
    monkeypatch.setattr(en._Cluster, "FEW", 5)
    fold = en._Cluster()
    for i, n in enumerate(names):
        fold.row((i, n))
    assert fold.shelf is not None and [n for _, n in fold.end()] == greedy(names)


@pytest.mark.parametrize("query", ["dedupe", "pairs", "ledger", "stamp"])
def test_pairs_of_a_crowded_list_stay_in_their_task(spark, monkeypatch, query):
    """Names of a few characters, as addresses are: no more pairs leave a join than there are names."""
    rng, out, real = random.Random(35), [], en._bounded
    monkeypatch.setattr(en, "_bounded", lambda met, *more: out.append(met.count()) or real(met, *more))
    xs = list(dict.fromkeys(f"{rng.choice(['thand', 'thether', 'tions'])}/{rng.choice(['en', 'de'])}/{rng.randrange(10 ** 5)}{rng.choice(['', '/', '?page=2'])}" for _ in range(400)))
    names = spark.createDataFrame([("l", i, n) for i, n in enumerate(xs)], "list_id string, pos bigint, name string")
    if query == "dedupe":
        got = [r["name"] for r in en.dedupe_names(names, ["list_id"]).orderBy("pos").collect()]
        assert got == greedy(xs)
    elif query == "pairs":
        few = [n for i, n in enumerate(xs) if i % 40 == 0]
        got = {tuple(r)[1:] for r in en.variant_pairs(names, None, ["list_id"]).filter(F.col("name").isin(few)).collect()}
        assert got == {(x, y) for x in few for y in xs if x != y and sim.same_reading(x, y)}
    else:
        asked, known = names.filter("pos % 2 = 0").select("list_id", "name"), names.filter("pos % 2 = 1")
        look, column = (en.ledger_status, "status") if query == "ledger" else (en.resolve_stamp, "stamp")
        found = look(asked, known.withColumn(column, F.concat(F.lit("v"), "pos")), ["list_id"]).collect()
        first = {x: next(((y, f"v{2 * j + 1}") for j, y in enumerate(xs[1::2]) if sim.same_reading(x, y)), (None, None)) for x in xs[::2]}
        assert {r["name"]: (r["matched"], r[column]) for r in found} == first
    assert sum(out) <= len(xs)


def test_pairs_scored_together_are_those_scored_alone():
    rng = random.Random(36)
    xs = random_names(rng, 120) + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(40)]
    xs += ["x" * 150, "x" * 149 + "y", "abc" * 60, "站1234567", "123456789 q", "", "·"]
    tokens = grid.Tokens()
    a, b = grid.Block(xs[::2], tokens), grid.Block(xs[1::2], tokens)
    i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
    got, back = grid.Texts(a, b).same(i, j)
    pairs = [(a.names[x], b.names[y]) for x, y in zip(i, j)]
    assert got.tolist() == [sim.same_reading(x, y) for x, y in pairs] and back.tolist() == [sim.same_reading(y, x) for x, y in pairs]
    near = {(x, y) for part in grid.possible(a, b) for x, y in zip(*map(np.ndarray.tolist, part))}
    assert {(x, y) for x, y, g, h in zip(i.tolist(), j.tolist(), got, back) if g or h} <= near and len(near) < len(i) // 2
    wide = grid.Block(["".join(chr(0x4e00 + k * 9 + c) for c in range(9)) for k in range(30)], tokens)
    texts = grid.Texts(wide, wide)
    assert not texts.usable and texts.same(np.array([1, 2]), np.array([1, 3]))[0].tolist() == [True, False]
