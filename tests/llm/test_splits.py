import random
from collections import Counter

from pyspark.sql import functions as F

from tracksift.llm.splits import deal_splits, grouped_codes, patient_code, rooted_forest, spanning_forest, with_person


def roots(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {x: find(x) for x in list(up)}


def test_groups_against_union_find(spark):
    rng = random.Random(2)
    links = [(f"S{rng.randrange(40):05d}", f"{rng.choice('SC')}{rng.randrange(40):05d}") for _ in range(60)]
    links += links[:3] + [(b, a) for a, b in links[:3]] + [("S00001", "S00001"), (None, "S00002"), ("S00003", None)]
    links += [(f"C{i:05d}", f"C{i + 1:05d}") for i in range(100, 140)]  # a long chain
    df = spark.createDataFrame(links, "a string, b string")
    want = roots(links)
    comps, forest = spanning_forest(df, "a", "b")
    groups = {}
    for r in comps.collect():
        groups.setdefault(r.comp, []).append(r.node)
    assert {x: min(g) for g in groups.values() for x in g} == want
    edges = [tuple(r) for r in forest.collect()]
    assert len(edges) == len(want) - len(set(want.values())) and set(edges) <= {tuple(sorted(x)) for x in links if None not in x}
    own = {x: x for x in want}
    assert {**own, **roots(edges)} == want  # a tree per group, so the forest joins what the links join
    few = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "x")], "a string, b string")
    assert {r.code: r.person for r in grouped_codes(few, "a", "b").collect()} == {"a": "a", "b": "a", "c": "a", "x": "x"}
    assert grouped_codes(few.where("false"), "a", "b").count() == 0


def test_rows_with_clashing_columns(spark):
    links = spark.createDataFrame([("a", "b"), ("b", None)], "code string, person string")
    rows = spark.createDataFrame([(1, "b", "x", "y"), (1, "b", "x", "y"), (2, "z", None, None), (3, None, "", "")], "rec_no int, code string, person string, patient_group string")
    got = sorted((r.rec_no, r.person, r.patient_group) for r in with_person(rows, F.col("code"), links, "code", "person").collect() if r.rec_no < 2)
    assert got == [(1, "x", "a"), (1, "x", "a")]
    assert {(r.rec_no, r.patient_group) for r in with_person(rows, F.col("code"), links, "code", "person").collect()} == {(1, "a"), (2, "z"), (3, None)}


def test_codes(spark):
    raw = ["(C00590)", "c_00589", "s0510", "C591", " S-00518 ", "S 7", "x", "", None, "S123456"]
    df = spark.createDataFrame([(x,) for x in raw], "t string").select(patient_code(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == ["C00590", "C00589", "S00510", "C00591", "S00518", "S00007", None, None, None, None]


def test_shares_and_whole_groups(spark):
    rng = random.Random(4)
    targets = [("train", 0.7), ("val", 0.15), ("test", 0.15)]
    for n_groups, hot, segment in ((60, 60, 50_000), (4000, 4000, 50_000), (4000, 4000, 700)):
        rows = [(g, rng.choice("ab"), i) for g in range(n_groups) for i in range(rng.choice([1, 2, 3]))] + [(-1, "a", i) for i in range(hot)] + [(None, None, 0)] * 3
        df = spark.createDataFrame(rows, "g bigint, trait string, split_name bigint")
        got = deal_splits(df, "g", [F.col("trait")], targets, segment=segment).collect()
        of = {r.g: r.split_name for r in got}
        assert len(got) == len(of) == n_groups + 2
        n = Counter(of[g] for g, _, _ in rows)
        assert all(abs(n[s] / len(rows) - share) < 0.01 for s, share in targets)
        b = Counter(of[g] for g, t, _ in rows if t == "b")
        if segment > n_groups:  # else each segment makes up for its part of the hot group's surplus
            assert all(abs(b[s] / sum(b.values()) - share) < 0.06 for s, share in targets)
        again = deal_splits(df.repartition(7), "g", [F.col("trait")], targets, segment=segment).collect()
        assert {r.g: r.split_name for r in again} == of
    assert deal_splits(df.where("false"), "g", [F.col("trait")], [("train", 1.0)]).count() == 0
    one = deal_splits(df.where("g = 3"), "g", [], targets).collect()
    assert [(r.g, r.split_name) for r in one] == [(3, "train")]


def test_forest_with_roots(spark):
    links = spark.createDataFrame([("b", "a"), ("b", "c"), ("c", "a"), ("x", "x"), ("y", "z")], "a string, b string")
    codes, edges = rooted_forest(links, "a", "b")
    assert {(r.code, r.person) for r in codes.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "y"), ("z", "y")}
    assert Counter(r.person for r in edges.collect()) == {"a": 2, "y": 1}
