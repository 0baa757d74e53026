import functools
import itertools
import random

from tracksift.llm.queries import primitives
from tracksift.llm.runs import SCALE, Vocabulary, label_runs, segment, slips


def cost(labels, costs, penalty):
    return sum(c[k] for c, k in zip(costs, labels)) + penalty * sum(a != b for a, b in zip(labels, labels[1:]))


def test_segmentation_is_optimal():
    rng = random.Random(5)
    for _ in range(300):
        n, k = rng.randint(1, 6), rng.randint(1, 3)
        costs = [tuple(round(SCALE * rng.choice([0, 0.1, 0.3, 0.5, 1.0])) for _ in range(k)) for _ in range(n)]
        penalty = rng.choice([0.0, 0.1, 0.25, 0.6])
        at = round(penalty * SCALE)
        best = min(cost(p, costs, at) for p in itertools.product(range(k), repeat=n))
        assert cost(segment(costs, penalty), costs, at) == best


def test_slips_and_words():
    assert [slips("reach", x) for x in ("reach", "rech", "reaach", "raech", "roach", "check")] == [0, 1, 1, 1, 1, 4]
    v = primitives()
    told = lambda t: (d := v.distances(t)) and v.labels[d.index(min(d))]
    assert [told(t) for t in ("l_retact", "Right hand transprot", "cup_r.rest_2", "IDLE", "restart", "l_glove", "", None, "cam_l_check")] == [
        "reposition", "transport", "idle", "idle", None, None, None, None, None]


def test_runs_over_partitions(spark):
    rng = random.Random(11)
    rows, expected = [], set()
    words = {"reach": ["l_reach", "reaach"], "idle": ["l_rest", "Idle "], "transport": ["trasnport"]}
    key = 0
    for who in ("hot", "b", "c"):
        t, label, run = 0.0, None, []
        events = []
        for _ in range(900 if who == "hot" else 25):
            label = rng.choice(list(words)) if label is None or rng.random() < 0.3 else label
            key += 1
            t += rng.choice([0.0, 0.5, 0.25])
            events.append((who, t, key, rng.choice(words[label]), label))
        for _, group in itertools.groupby(events, key=lambda e: e[4]):
            run = list(group)
            expected.add((who, run[0][4], run[0][2], run[-1][2], len(run)))
        rows += events
    rows += rng.sample(rows, 200)  # redelivered
    rows += [("hot", None, 9001, "l_reach", ""), (None, 1.0, 9002, "l_reach", ""), ("hot", 1.0, 9003, None, ""), ("hot", 1.0, None, "l_idle", ""),
             ("hot", 2.0, 9004, "talking", ""), ("hot", float("nan"), 9005, "l_idle", "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "who string, t double, k bigint, x string, label string")
    got = label_runs(df, ["who"], "t", "k", "x", primitives).collect()
    assert {(r.who, r.label, r.first_key, r.last_key, r.n_events) for r in got} == expected and len(got) == len(expected)
    assert label_runs(df.where("false"), ["who"], "t", "k", "x", primitives).count() == 0


letters = functools.partial(Vocabulary, {"a": ["aaaa"], "b": ["aaab"], "c": ["aabb"], "d": ["abbb"]}, max_slips=8)


def test_borders_make_no_difference(spark):
    """Where a boundary costs much, labels hang on far events; the optimum is found over partitions all the same."""
    rng = random.Random(21)
    vocabulary, texts = letters(), ["aaaa", "aaab", "aabb", "abbb", "abab", "aaba", "bbbb"]
    for penalty in (0.1, 0.3, 0.8, 2.0):
        rows, key = [], 0
        for who, n in (("hot", 160), ("b", 1), ("c", 9), ("d", 60)):
            for t in range(n):
                key += 1
                rows.append((who, float(t // 2), key, rng.choice(texts)))
        df = spark.createDataFrame(rows + rows[::7], "who string, t double, k bigint, x string").repartition(3)
        runs = label_runs(df, ["who"], "t", "k", "x", letters, penalty).collect()
        at = round(penalty * SCALE)
        for who in "hot", "b", "c", "d":
            events = [r for r in rows if r[0] == who]
            costs = [vocabulary.distances(r[3]) for r in events]
            mine = sorted((r for r in runs if r.who == who), key=lambda r: r.first_key)
            assert all(x.label != y.label and x.last_key + 1 == y.first_key for x, y in zip(mine, mine[1:]))
            labels = [vocabulary.labels.index(r.label) for r in mine for _ in range(r.n_events)]
            assert len(labels) == len(events) and cost(labels, costs, at) == cost(segment(costs, penalty), costs, at)


def test_near_identical_events_merge_when_a_boundary_costs_more():
    v = Vocabulary({"a": ["aaaa"], "b": ["aaab"]}, max_slips=2)
    costs = [v.distances(x) for x in ("aaaa", "aaab", "aaaa")]
    assert segment(costs, 0.2) == [0, 0, 0] and segment(costs, 0.05) == [0, 1, 0]
