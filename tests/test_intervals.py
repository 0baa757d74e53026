import random

from tracksift.operators.intervals import periods_and_gaps, time_spans

SCHEMA = "id string, s bigint, e bigint, kind string"


def brute(rows):
    out = set()
    for key in {r[0] for r in rows if r[0] is not None}:
        merged = []
        for s, e in sorted((r[1], r[2]) for r in rows if r[0] == key and r[1] is not None and r[2] is not None and r[1] < r[2]):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "period", s, e) for s, e in merged}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def found(spark, rows, cell):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(df, ["id"], "s", "e", cell).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force_with_small_cells(spark):
    rng = random.Random(7)
    for cell in (5, 16, 1000):
        rows = []
        for key in ("a", "b", "hot", "c"):
            for _ in range(200 if key == "hot" else 12):
                s = rng.randrange(-50, 400)
                rows.append((key, s, s + rng.choice([0, 1, 2, 5, 5, 16, 40]), "x"))
        rows += rows[:20]
        assert found(spark, rows, cell) == brute(rows)


def test_edges(spark):
    rows = [("a", 0, 10, None), ("a", 10, 20, None), ("a", 25, 25, None), ("a", 30, 29, None), ("a", None, 5, None),
            ("a", 40, None, None), (None, 0, 5, None), ("a", 50, 60, None), ("a", 50, 60, None), ("b", 3, 3, None)]
    assert found(spark, rows, 10) == {("a", "period", 0, 20), ("a", "gap", 20, 50), ("a", "period", 50, 60)}
    assert found(spark, [], 10) == set()


def test_spans_are_read_in_every_spelling(spark):
    text = "<RESP> a <TIME> 1.5-2 <resp> b <time> 00:03.000 - 00:04.250 <RESP> c <TIME> 5s–6.5s <TIME> 1:00 to 61.5 <TIME> x-y"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(time_spans("t").alias("x"))
    got = [r.x and [tuple(s) for s in r.x] for r in df.collect()]
    assert got[0] == [(1500, 2000), (3000, 4250), (5000, 6500), (60000, 61500)] and got[1:] == [[], None]


def test_long_intervals_are_three_parts_at_most(spark):
    rows = [("a", 3, 10**12), ("a", 500, 700), ("a", 10**12 + 5, 10**12 + 9), ("b", 15, 17)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    out = periods_and_gaps(df, ["k"], "s", "e", 10)
    got = {tuple(r) for r in out.collect()}
    assert got == {("a", "period", 3, 10**12), ("a", "gap", 10**12, 10**12 + 5), ("a", "period", 10**12 + 5, 10**12 + 9), ("b", "period", 15, 17)}
