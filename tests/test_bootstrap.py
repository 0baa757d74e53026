import math
import random
import statistics

import pytest

from tracksift.operators import metrics as M
from tracksift.operators.bootstrap import bootstrap
from tracksift.operators.corpus_scores import corpus_scores
from tracksift.plans import task as T

TEXTS = ["the hand lifts a red mug from the table", "the hand lifts a mug", "a spoon is put down on the plate", "the arm rests on the long table now"]


def resampled(f, items, rounds, seed=1):
    """Brute force: the statistic of drawn lists."""
    rng = random.Random(seed)
    return statistics.stdev(f(rng.choices(items, k=len(items))) for _ in range(rounds))


def f1(items):
    tp, g, p = (sum(map(h, items)) for h in (all, lambda x: x[0], lambda x: x[1]))
    return 2 * tp / (g + p) if g + p else 0.0


def matthews(items):
    tp, tn = sum(g and p for g, p in items), sum(not g and not p for g, p in items)
    fp, fn = sum(p and not g for g, p in items), sum(g and not p for g, p in items)
    d = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return (tp * tn - fp * fn) / math.sqrt(d) if d else 0.0


@pytest.mark.parametrize(("name", "f"), [("perplexity", lambda x: math.exp(-statistics.mean(x))), ("median", statistics.median), ("mean", statistics.mean)])
@pytest.mark.parametrize("digits", [0, 9])
def test_numbers(spark, name, f, digits):
    rng = random.Random(5)
    items = [round(rng.gauss(0, 2), digits) for _ in range(30)]
    df = spark.createDataFrame([("a", x) for x in items] + [("a", None), ("b", 1.0)], "k string, v double")
    got = {r.k: r.stderr for r in bootstrap(df, ["k"], ["v"], name, 5500).collect()}
    assert got.keys() == {"a"} and got["a"] == pytest.approx(resampled(f, items, 4000), rel=0.08)
    assert bootstrap(df.repartition(7), ["k"], ["v"], name, 5500).first().stderr == pytest.approx(got["a"], rel=1e-9)


@pytest.mark.parametrize(("how", "f"), [("f1", f1), ("matthews", matthews)])
def test_task_of_truths(spark, how, f):
    rng = random.Random(7)
    items = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(40)]
    row = evaluated(spark, how, [(str(g).lower(), str(p).lower()) for g, p in items])
    assert row.n == 40 and row.value == pytest.approx(f(items)) and row.stderr == pytest.approx(resampled(f, items, 4000), rel=0.08)


@pytest.mark.parametrize("how", ["bleu", "chrf", "ter"])
def test_task_of_texts(spark, how):
    rng = random.Random(9)
    items = [(a, " ".join(rng.sample(a.split(), len(a.split()) - 1)) if i % 2 else a) for i, a in enumerate(TEXTS * 5)]
    row = evaluated(spark, how, items)
    drawn = [(k, g, p) for k in range(100) for g, p in rng.choices(items, k=len(items))]
    want = [r[how] for r in corpus_scores(spark.createDataFrame(drawn, "k int, g string, p string"), ["k"], "p", "g").collect()]
    assert row.n == 20 and row.stderr == pytest.approx(statistics.stdev(want), rel=0.35)
    assert row.value == pytest.approx(statistics.mean(want), abs=4 * row.stderr)


def evaluated(spark, how, items):
    task = T.Task("t", None, "", "", metrics=(("pair", how),))
    asked = spark.createDataFrame([("t", i, 0, g, [p]) for i, (g, p) in enumerate(items)], "task string, doc_id int, repeat int, target string, resps array<string>")
    return T.results(task, T.samples(task, asked)).first()


def test_task_perplexity_and_rounds(spark):
    task = T.Task("t", None, "", "", metrics=(("exact_match", "perplexity"), ("contains", "median"), ("pair", "ter")))
    asked = spark.createDataFrame([("t", i, 0, "a", ["ab"[i % 3 > 0]]) for i in range(30)], "task string, doc_id int, repeat int, target string, resps array<string>")
    rows = {r.metric: r for r in T.results(task, T.samples(task, asked)).collect()}
    p = 1 / 3
    assert rows["exact_match"].stderr == pytest.approx(math.exp(-p) * math.sqrt(p * (1 - p) / 30), rel=0.03)
    assert rows.keys() == {"exact_match", "contains", "pair"} and rows["contains"].stderr is not None and rows["pair"].stderr > 0
    assert all(r.stderr is None for r in T.results(task, T.samples(task, asked), rounds=0).collect())
    assert all(r.stderr is None for r in T.results(task, T.samples(task, asked.where("doc_id = 0"))).collect())


def test_as_many_rounds_as_the_harness(spark):
    """Two seeds agree to the precision of 100,000 rounds; 200 rounds miss it widely."""
    df = spark.createDataFrame([("a", float(i * i)) for i in range(51)], "k string, v double")
    a, b = (bootstrap(df, ["k"], ["v"], "median", seed=s).first().stderr for s in (0, 1))
    assert a == pytest.approx(b, rel=0.012)
    c, d = (M.bootstrap_stderr(df, ["k"], "v", "v", seed=s).first().stderr for s in (0, 1))
    assert c == pytest.approx(d, rel=0.012)
