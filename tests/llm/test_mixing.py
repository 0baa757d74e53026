import random

import pytest
from pyspark.sql import functions as F

from tracksift.llm.mixing import mix, source_name, token_counts
from tracksift.llm.queries import tokenizer_path


def shares(rows):
    used = {}
    for r in rows:
        used[r.source] = used.get(r.source, 0) + r.n_uses * r.n_tokens
    total = sum(used.values())
    return {s: u / total for s, u in used.items()}


def test_targets_are_met_within_the_repeats(spark):
    rng = random.Random(1)
    rows = [(i, rng.choices(["big", "mid", "small", "off", None], [700, 200, 60, 20, 20])[0], int(rng.lognormvariate(4, 1)), "x") for i in range(6000)]
    rows += [(9001, "big", None, "x"), (9002, "mid", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, n_uses string")
    targets = [("big", 0.4, 1), ("mid", 0.35, 2), ("small", 0.25, 5), ("absent", 0.1, 3)]
    got = mix(df, "doc_id", targets).collect()
    assert len(got) == len(rows)
    real = shares(got)
    for s, want in (("big", 0.4), ("mid", 0.35), ("small", 0.25)):
        assert abs(real[s] - want) < 0.005
        assert {round(r.real_share, 9) for r in got if r.source == s} == {round(real[s], 9)}
    caps = {s: n for s, _, n in targets}
    assert all(0 <= r.n_uses <= caps.get(r.source, 0) for r in got)
    assert all(r.n_uses == 0 for r in got if r.source in ("off", None) or not r.n_tokens)


def test_least_entropy(spark):
    """Against a scalar search for each source's multiplier."""
    import math

    from tracksift.llm.mixing import balance

    sizes = [("a", 10, 5), ("a", 40, 3), ("b", 7, 9), ("b", 100, 1)]
    df = spark.createDataFrame(sizes, "source string, n_tokens bigint, n bigint")
    goals, caps, means = {"a": 260.0, "b": 60.0}, {"a": 2, "b": 2}, {"a": 170 / 8, "b": 16.3}
    got = balance(df, goals, caps, 1.0, means)
    for s in goals:
        assert sum(n * t * min(caps[s], math.exp(got[s] * t / means[s])) for k, t, n in sizes if k == s) == pytest.approx(goals[s], rel=1e-5)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 3)], "doc_id bigint, source string, n_tokens bigint")
    assert mix(df.where("false"), "doc_id", [("a", 1.0, 1)]).count() == 0
    assert {(r.doc_id, r.n_uses) for r in mix(df, "doc_id", [("z", 1.0, 1)]).collect()} == {(1, 0), (2, 0)}
    names = spark.createDataFrame([(" Session-Note",), ("SESSION note",), (None,)], "s string").select(source_name(F.col("s")).alias("s"))
    assert [r.s for r in names.collect()] == ["session_note", "session_note", None]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "word " * 20000)], "k bigint, text string")
    got = {r.k: r.n_tokens for r in token_counts(df, "text", tokenizer_path(), ["k"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 20000
