"""Small cases worked out by hand, and plain-Python versions of stateful passes."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions import text as X
from tracksift.operators import metrics as M
from tracksift.operators import responses as R
from tracksift.operators import sampling as P
from tracksift.operators import sequences as S
from tracksift.operators import state as K
from tracksift.operators import stats as Z
from tracksift.operators import windows as W
from tracksift.operators.corpus_scores import corpus_scores, translation_edits
from tracksift.operators.interval_joins import asof_join, overlap_join, substring_join
from tracksift.operators.ranks import running_total
from tracksift.plans import catalog_more, catalog_tasks  # noqa: F401 (they register their queries)
from tracksift.plans.catalog import QUERIES
from tracksift.sources.tables import log_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LABELS = ["idle", "reach", "transport", "stabilize", "reposition"]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def seq_df(spark, labels, schema="id string, t int, label string"):
    return spark.createDataFrame([("v", i, x) for i, x in enumerate(labels)], schema)


def test_edit_scores(spark):
    rows = [(["idle", "reach", "transport"], ["idle", "transport"]), ([], []), (["idle", "idle"], ["idle"]), (["reach"], [])]
    df = spark.createDataFrame(rows, "p array<string>, r array<string>")
    got = [tuple(round(v, 6) for v in r) for r in S.edit_scores(df, "p", "r", LABELS).select("distance", "edit_score", "action_error_rate", "rce").collect()]
    assert got == [(1, 66.666667, 0.5, 0.5), (0, 100.0, 0.0, 0.0), (0, 100.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0)]


def test_collapse_and_codec(spark):
    out = S.collapse(seq_df(spark, ["a", "a", "b", "b", "a", None, None]), ["id"], ["t"], "label").orderBy("t").collect()
    assert [r.label for r in out] == ["a", "b", "a", None]
    code = value(spark, S.encode_track(arr("idle", "reach"), F.array(F.lit(0.0), F.lit(1.5), F.lit(3.0))))
    assert code == "idle@0.000;reach@1.500;reach@3.000"
    for text, labels, times in ((code, ["idle", "reach"], [0.0, 1.5, 3.0]), ("idle@0.0", ["idle"], [0.0]), ("", [], [])):
        d = value(spark, S.decode_track(F.lit(text)))
        assert (d.labels, d.times) == (labels, times)


def test_lookahead_is_inclusive(spark):
    flags = [(True, False), (True, False), (True, True), (False, False), (True, False)]
    df = spark.createDataFrame([("v", i * 1000, m, c) for i, (m, c) in enumerate(flags)], "id string, t bigint, m boolean, c boolean")
    out = S.lookahead_labels(df, ["id"], "t", F.col("m"), F.col("c"), 2000).orderBy("t").collect()
    assert [r.label for r in out] == ["reach", "reach", "transport", "idle", "reposition"]


def test_backward_repair(spark):
    out = S.backward_repair(seq_df(spark, ["reach", "reach", "transport", "reach", "idle", "reach"]), ["id"], ["t"], "label").orderBy("t").collect()
    assert [r.repaired for r in out] == ["reach", "reach", "transport", "reposition", "idle", "reposition"]


def named_runs(labels):
    out, n, i = list(labels), len(labels), 0
    while i < n:
        if labels[i] != "UNK":
            i += 1
            continue
        j = i
        while j < n and labels[j] == "UNK":
            j += 1
        a, b = labels[i - 1] if i else None, labels[j] if j < n else None
        for k in range(i, j):
            early = k <= (i + j - 1) // 2
            out[k] = ("idle" if a is None and b is None else ("reach" if early else "reposition") if a == b == "idle" else
                      ("reposition" if early else "reach") if a == b == "transport" else "reach" if b == "transport" else "reposition")
        i = j
    return out


def test_unknown_runs(spark):
    rng = random.Random(8)
    seqs = {f"v{i}": [rng.choice(["UNK", "UNK", "idle", "transport"]) for _ in range(rng.randint(1, 12))] for i in range(40)}
    df = spark.createDataFrame([(k, i, x) for k, s in seqs.items() for i, x in enumerate(s)], "id string, t int, label string")
    got = {}
    for r in S.unknown_runs(df, ["id"], ["t"], "label").orderBy("id", "t").collect():
        got.setdefault(r.id, []).append(r.repaired)
    assert got == {k: named_runs(s) for k, s in seqs.items()}


def frames_of(spark, seqs):
    return spark.createDataFrame([(k, i, x) for k, s in seqs.items() for i, x in enumerate(s)], "id string, _pos bigint, label string")


def by_key(df, label="label", at="_pos"):
    got = {}
    for r in df.orderBy("id", at).collect():
        got.setdefault(r.id, []).append(r[label])
    return got


def test_windows_are_filled(spark):
    cases = {"a": "AABBAAB", "b": "AABBBBAA", "c": "ABBBAB", "d": "BBAABAABAA", "e": "A", "f": "AAB", "g": "BBBBBBB", "h": "AACCAB"}
    want = {"a": "AAAAAAA", "b": "AABBBBAA", "c": "ABAAAB", "d": "BBAAAAAAAA", "e": "A", "f": "AAA", "g": "BBBBBBB", "h": "AAAAAB"}
    assert by_key(K.fill_windows(frames_of(spark, cases), "id", "label", "A", 2)) == {k: list(v) for k, v in want.items()}
    rng = random.Random(8)
    seqs = {f"v{i}": rng.choices("AAB", k=rng.randint(1, 25)) for i in range(60)}
    got = by_key(K.fill_windows(frames_of(spark, seqs), "id", "label", "A", 3))
    for k, s in seqs.items():  # what a filled frame must have around it, window by window
        heads = [x == "A" for x in s[::3]]
        now = list(heads)
        for i in range(len(heads)):
            part = s[3 * i : 3 * i + 3]
            inside = 0 < i < len(heads) - 1 and now[i - 1] and heads[i + 1]
            tail = len(part) < 3 and i > 0 and now[i - 1]
            now[i] = heads[i] or inside or tail
            assert got[k][3 * i : 3 * i + 3] == (["A"] * len(part) if inside or tail else part)


def test_turns_are_opened(spark):
    idle, move = "idle", "transport"
    cases = {"one": [idle] * 3 + [move] * 3, "back": [move] * 2 + [idle] * 2, "close": [idle, move, idle, move, idle, move], "none": [idle, "reach", move], "empty": [None, move]}
    turns = {(idle, move): "reach", (move, idle): "reposition"}
    got = by_key(K.open_turns(frames_of(spark, cases), "id", "label", 1, turns))
    assert got["one"] == [idle, idle, "reach", "reach", move, move] and got["back"] == [move, "reposition", "reposition", idle]
    assert got["close"] == ["reach", "reach", "reach", "reach", "reach", "reach"] and got["none"] == cases["none"] and got["empty"] == cases["empty"]
    wide = by_key(K.open_turns(frames_of(spark, {"v": [idle] * 4 + [move] * 3 + [idle] * 4}), "id", "label", 2, turns))
    assert wide["v"] == [idle, idle, "reach", "reach", "reach", "reposition", "reposition", "reposition", "reposition", idle, idle][: 11]


def test_held_steady_frames(spark):
    rows = [("v", t, "x", 1 <= t <= 20, t in (2, 3, 4, 5) or t in (15, 16)) for t in range(24)] + [("w", t, "x", t < 9, t == 1) for t in range(12)] + [("n", 0, "x", None, None)]
    df = spark.createDataFrame(rows, "id string, t int, label string, h boolean, s boolean")
    got = by_key(K.hold_stabilize(df, "id", ["t"], "label", "h", "s", 2), at="t")
    assert [i for i, x in enumerate(got["v"]) if x == "stabilize"] == [2, 3, 4, 5, 19, 20]
    assert got["w"] == ["x"] * 12 and got["n"] == ["x"]
    assert [i for i, x in enumerate(by_key(K.hold_stabilize(df.where("t >= 13"), "id", ["t"], "label", "h", "s", 2), at="t")["v"]) if x == "stabilize"] == [6, 7]


def test_flags_turn_set_and_stay(spark):
    rng = random.Random(3)
    rows = [(k, t, rng.random() < 0.4, rng.choice([True, False, False, None])) for k in range(20) for t in range(30)]
    df = spark.createDataFrame(rows, "id int, t int, starts boolean, ends boolean")
    got = {(r.id, r.t): r.on for r in K.two_flag_states(df, ["id"], ["t"], {"on": F.col("starts")}, {"on": F.col("ends")}).collect()}
    state, last = False, None
    for k, t, starts, ends in sorted(rows, key=lambda r: r[:2]):
        state = (not ends if state else starts) if k == last else starts
        last = k
        assert got[k, t] == state


def test_tracker():
    t = K.Tracker(0.3, max_age=1)
    assert t.frame([(0, 0, 2, 2), (10, 10, 12, 12)]) == [1, 2]
    assert t.frame([(10, 10, 12, 12), (0, 0, 2, 2.2)]) == [2, 1]
    assert t.frame([]) == [] and t.frame([]) == [] and t.frame([(0, 0, 2, 2)]) == [3]
    assert K.box_iou((0, 0, 1, 1), (2, 2, 3, 3)) == 0.0 and K.box_iou((0, 0, 2, 2), (0, 0, 2, 2)) == 1.0


def test_filters(spark):
    run = lambda steps, *xs: value(spark, R.pipeline(steps)(arr(*xs)))
    assert run([("majority_vote", {})], "b", "a", "a", "b") == ["b"]
    assert run([("majority_vote", {})]) == []
    assert run([("regex", {"pattern": r"#### (\d+)", "group_select": -1})], "x #### 12 #### 7", "none") == ["7", "[invalid]"]
    assert run([("remove_whitespace", {})], "  x") == [" x"]
    assert run([("map", {"table": {"a": "1"}, "default": "-"})], "a", "z") == ["1", "-"]
    assert run([("take_first_k", {"k": 3})], "a") is None
    assert run([("multi_choice", {"choices": arr("cat", "dog")})], "It is a dog, no cat.", "(B)", "so: A", "?") == ["(B)", "(B)", "(A)", "[invalid]"]
    with pytest.raises(ValueError):
        R.register_filter("map")(lambda: None)


def test_text_functions(spark):
    assert value(spark, X.final_answer(F.lit('so\nfinal_answer: "Face wash." <TIME>'))) == "Face wash"
    assert value(spark, X.final_answer(F.lit("FINAL_ANSWER: x"), ["y"])) == "" and value(spark, X.final_answer(F.lit(None).cast("string"))) == ""
    assert value(spark, X.clock(F.lit(3725.5))) == "01:02:05.500"
    args = value(spark, X.typed_args(F.lit("a=1,b=2.5,c=True,d=x")))
    assert {k: v.kind for k, v in args.items()} == {"a": "int", "b": "float", "c": "bool", "d": "str"}
    assert value(spark, X.answer_tokens(F.lit("The Two, cats (3.5) one-day."))) == "2 cats 3.5 1 day"
    assert value(spark, X.common_prefix_length(arr("a", "b", "c"), arr("a", "b", "d"))) == 2 and value(spark, X.common_prefix_length(arr("a"), arr("a"))) == 1
    assert value(spark, X.elided(F.lit("abcdefghijklmnop"), 11)) == "abc ... nop"
    assert value(spark, X.detokenized(F.lit("it 's ( fine ) , is n't it ?"))) == "it's (fine), isn't it?"


def test_windows(spark):
    wins = lambda n, k, v: [tuple(w) for w in value(spark, W.dense_windows(F.lit(n), k, v))]
    assert wins(10, 4, 0) == [(0, 4), (4, 8), (8, 10)] and wins(10, 4, 2) == [(0, 4), (2, 6), (4, 8), (6, 10)] and wins(0, 4, 0) == [] and wins(3, 4, 0) == [(0, 3)]
    assert value(spark, W.uniform_frames(F.lit(10), 4)) == [0, 3, 6, 9] and value(spark, W.uniform_frames(F.lit(2), 4)) == [0, 1]
    df = spark.createDataFrame([("v", i, c, float(e)) for i, (c, e) in enumerate([(1, 2), (2, 4), (1, 6)])], "id string, t int, c int, e double")
    assert W.threshold_time(df, ["id"], ["t"], "c", "e", 4).first().reached_at == 6.0 and W.threshold_time(df, ["id"], ["t"], "c", "e", 5).first().reached_at is None


def test_metrics(spark):
    assert value(spark, M.anls(F.lit("abd"), arr("abc"))) == pytest.approx(2 / 3) and value(spark, M.anls(F.lit("xyz"), arr("abc"))) == 0.0
    assert value(spark, M.choice_accuracy(F.array(F.lit(0.4), F.lit(0.1)), F.lit(1))) == 1.0 and value(spark, M.choice_accuracy(F.array(F.lit(0.4)), F.lit(7))) == 0.0
    df = spark.createDataFrame([(0.1, 2), (0.2, 2)], "se double, n bigint")
    assert df.agg(M.pooled_stderr(F.col("se"), F.col("n")).alias("x")).first().x == pytest.approx(0.111803, abs=1e-6)
    arrived = spark.createDataFrame([("k", 0, 9.0), ("k", 1, 1.0), ("k", 2, 5.0)], "k string, o int, v double")
    assert M.arrival_median(arrived, ["k"], "o", "v").first().mid == 1.0 and arrived.agg(M.median(F.col("v")).alias("b")).first().b == 5.0
    flags = spark.createDataFrame([(True, True), (None, True), (False, True), (None, False), (True, None)], "g boolean, p boolean").agg(*M.masked_f1(F.col("g"), F.col("p"))).first()
    assert flags.f1_low <= flags.f1 <= flags.f1_high and flags.coverage == 0.4


def test_quantiles_against_percentile(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([round(rng.gauss(0, 5), 1), 2.0])) for _ in range(500)] + [("c", 7.0), ("d", None), ("hot", float("nan")), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double").where("k IS NOT NULL")
    got = {r.k: (r.q0, r.q1, r.q2) for r in M.exact_quantiles(df, ["k"], "v", [0.0, 0.5, 0.95]).collect()}
    want = df.where("NOT isnan(v)").groupBy("k").agg(F.percentile("v", F.array(F.lit(0.0), F.lit(0.5), F.lit(0.95))).alias("x")).where("x IS NOT NULL").collect()
    assert set(got) == {"hot", "b", "c"} and all(got[r.k] == pytest.approx(tuple(r.x)) for r in want)
    assert M.exact_quantiles(df.where("false"), ["k"], "v", [0.5]).count() == 0


def test_bootstrap_is_near_the_closed_form(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([("k", i, rng.gauss(0, 1)) for i in range(500)], "k string, i bigint, v double")
    closed = df.agg(M.stderr(F.col("v")).alias("x")).first().x
    assert M.bootstrap_stderr(df, ["k"], "v", "i", 300).first().stderr == pytest.approx(closed, rel=0.15)


def test_statistics(spark):
    lo, hi = Z.wilson(F.lit(50), F.lit(100.0))
    assert value(spark, lo) == pytest.approx(0.403830, abs=1e-6) and value(spark, hi) == pytest.approx(0.596170, abs=1e-6)
    assert Z.chi_square_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and Z.chi_square_p(20.0, 3) == pytest.approx(0.000169742, rel=1e-4)
    assert Z.fisher_p(3, 1, 1, 3) == pytest.approx(0.4857142857) and Z.fisher_p(0, 0, 0, 0) == 1.0


def test_samples(spark):
    df = spark.range(10).withColumnRenamed("id", "k").withColumn("x", F.lit("a"))
    assert sorted(r.k for r in P.stride_shard(df, "k", 1, 3, 8).collect()) == [1, 4, 7]
    assert [r.n for r in P.balanced_split(df.where("k < 7"), "k", 3).groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()] == [3, 2, 2]
    assert P.limit_fraction(df.where("k < 7"), "k", 0.5).count() == 4 and P.limit_fraction(df, "k", 3).count() == 3


def test_running_total_with_hot_and_null_keys(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.o): r.s for r in running_total(df, ["k"], F.floor(F.col("o") / 7), ["o"], F.col("v"), "s").collect()}
    sums, want = {}, {}
    for k, o, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[k, o] = sums[k]
    assert got == want


def test_interval_joins_against_brute_force(spark):
    rng = random.Random(12)
    side = lambda: [(rng.choice("ab"), a := rng.randrange(60), a + rng.randrange(0, 25), rng.choice("xy")) for _ in range(40)]
    left, right = side(), side()
    schema = "k string, t0 bigint, t1 bigint, label string"
    got = sorted(tuple(r) for r in overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], 7).collect())
    want = sorted((a[0], a[1], a[2], a[3], b[1], b[2], b[3], max(a[1], b[1]), min(a[2], b[2])) for a in left for b in right if a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2]))
    assert got == want
    probes = [(k, t) for k in "abc" for t in range(0, 60, 7)]
    p = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(probes)], "k string, probe_id bigint, at bigint")
    m = spark.createDataFrame([(k, t, lab) for k, t, _, lab in left], "k string, at bigint, v string")
    out = {r.probe_id: r.v for r in asof_join(p, m, ["k"], "at", "v", "none").collect()}
    for i, (k, t) in enumerate(probes):
        before = [(t0, lab) for kk, t0, _, lab in left if kk == k and t0 <= t]
        assert out[i] == (max(before)[1] if before else "none")


def test_substring_join(spark):
    texts, needles = ["alphabet soup", "betamax", "xx", ""], ["bet", "soup", "alphabetx", "max"]
    t, n = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in needles], "n string")
    assert {tuple(r) for r in substring_join(t, "t", n, "n", 3).distinct().collect()} == {(a, b) for a in texts for b in needles if b in a}


def test_substring_join_of_short_needles(spark):
    texts, needles = ["alphabet soup", "betamax", "xx", "x", "", None], ["x", "be", "xx", "soup", "q", "", None]
    t, n = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in needles], "n string")
    got = sorted(tuple(r) for r in substring_join(t, "t", n, "n", 3).collect())
    assert got == sorted((a, b) for a in texts for b in needles if a is not None and b is not None and b in a)


@pytest.mark.parametrize(("many", "joins"), [(300, "BroadcastHashJoin"), (60_000, "SortMergeJoin")])
def test_substring_join_never_broadcasts_the_grams(spark, many, joins):
    """Sizes are known here, and the texts are the smaller table before their grams are listed."""
    t = spark.range(200).select(F.concat(F.lit("item number "), F.col("id").cast("string"), F.lit(" of the list")).alias("t"))
    n = spark.range(many).select(F.concat(F.lit("number "), F.col("id").cast("string"), F.lit(" ")).alias("n"))
    out = substring_join(t, "t", n, "n", 3)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert joins in plan and "BuildLeft" not in plan
    assert sorted(r.t for r in out.collect()) == sorted(r.t for r in t.collect())


def test_corpus_scores_of_empty_answers(spark):
    df = spark.createDataFrame([("g", "", "a b")], "k string, h string, r string")
    row = corpus_scores(df, ["k"], "h", "r").first()
    assert (row.bleu, row.chrf, row.ter) == (0.0, 0.0, 100.0)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_corpus_scores_of_all_tasks(spark):
    log = log_rows(spark, SF, "sample_log", "task", "target", "filtered_resps").where("filtered_resps IS NOT NULL AND target IS NOT NULL")
    assert {(r.task, r.n) for r in QUERIES["agg_corpus_scores"](spark, SF).collect()} == {tuple(r) for r in log.groupBy("task").count().collect()}


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_whole_sample_log(spark):
    log = log_rows(spark, SF, "sample_log", "task", "doc_id", "target", "arguments", "resps", "filtered_resps")
    text = F.to_json(F.struct("doc_id", "target", "arguments", "resps", "filtered_resps"), {"ignoreNullFields": "false"})
    got, want = (sorted(r[0] for r in df.select(text).collect()) for df in (QUERIES["io_jsonl_whole"](spark, SF), log))
    assert got == want


def test_corpus_scores(spark):
    df = spark.createDataFrame([("g", "the cat sat on the mat", "the cat sat on the mat"), ("g", None, "x")], "k string, h string, r string")
    row = corpus_scores(df, ["k"], "h", "r").first()
    assert (row.n, round(row.bleu, 6), round(row.chrf, 6), row.ter) == (1, 100.0, 100.0, 0.0)
    assert translation_edits("b c a".split(), "a b c".split()) == 1 and translation_edits([], ["a"]) == 1


def test_two_flag_states_follow_the_state(spark):
    rows = [("v", i, a, b) for i, (a, b) in enumerate([(False, True), (True, True), (True, False), (True, True), (False, False)])]
    df = spark.createDataFrame(rows, T.StructType.fromDDL("id string, t int, starts boolean, ends boolean"))
    out = K.two_flag_states(df, ["id"], ["t"], {"on": F.col("starts")}, {"on": F.col("ends")}).orderBy("t").collect()
    assert [r.on for r in out] == [False, True, True, False, False]
