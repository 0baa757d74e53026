"""Edge cases of selections, scores, tracks, names, groups, files and declarations."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tracksift.functions import geometry as G
from tracksift.functions import names as N
from tracksift.functions.text import contraction_table
from tracksift.operators import grouped as GR
from tracksift.operators import metrics as M
from tracksift.operators import sampling as P
from tracksift.operators import scoring as Q
from tracksift.operators import selection as C
from tracksift.operators import sequences as S
from tracksift.operators import state as K
from tracksift.operators import stats as Z
from tracksift.operators import tracks as R
from tracksift.operators.corpus_scores import cut_words, edit_distance
from tracksift.operators.interval_joins import asof_join
from tracksift.operators.ranks import RANGE, ranged, running_total
from tracksift.plans import task as T
from tracksift.sources import logs as L


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_selections(spark):
    df = spark.createDataFrame([("a",), ("bc",), (None,), ("",)], "x string")
    names = lambda **kw: sorted((r.x or "-") for r in C.select_rows(df, "x", **kw).collect())
    assert names(names="a, bc") == ["a", "bc"] and names(names="all") == names() == ["-", "-", "a", "bc"]
    assert names(names="a", pattern="c$") == ["bc"] and names(without="^b") == ["-", "-", "a"]
    assert C.range_values("5-3, 9,4") == [3, 4, 5, 9]
    with pytest.raises(ValueError):
        C.range_values("3-x")
    over = lambda a, b: value(spark, C.range_overlap(F.lit(a).cast("int"), F.lit(b).cast("int"), "3-5,9"))
    assert (over(5, 8), over(6, 8), over(9, 9), over(None, 4)) == (True, False, True, False)
    spark.conf.set("tracksift.some", "x")
    assert C.parameter(spark, "some", "y") == "x" and C.parameter(spark, "other", "y") == "y"
    spark.conf.unset("tracksift.some")
    pairs = spark.createDataFrame([("a", None), ("b", "c")], "p string, q string")
    got = C.member_flag(pairs, ["p", "q"], pairs.where("q IS NULL")).collect()
    assert {(r.p, r.is_member) for r in got} == {("a", True), ("b", False)}
    assert C.complete_groups(pairs.union(pairs.where("q IS NULL")), ["p", "q"], 2).count() == 2
    assert C.flagged(spark.createDataFrame([(True,), (None,), (False,)], "is_x boolean"), "x", "is_").count() == 1
    with pytest.raises(Exception, match="one answer per question"):
        value(spark, C.transposed_blocks(F.array(arr("a")), arr("q", "r")))


def test_scores(spark):
    score = lambda g: (F.lit("a") == g).cast("double")
    none = F.array().cast("array<string>")
    assert (value(spark, Q.any_match(arr("b", "a"), score)), value(spark, Q.any_match(none, score)), value(spark, Q.max_over(none, score))) == (1.0, 0.0, None)
    pos = lambda g: value(spark, Q.gold_positions(F.lit(g), arr("x", "y")))
    assert (pos("y"), pos("1"), pos("[0, 5]"), pos("-1"), pos("zz"), pos(None)) == ([1], [1], [0, -100], [-100], [-100], [-100])
    part = lambda se, n, v: F.struct(F.lit(se).alias("se"), F.lit(n).alias("n"), F.lit(v).alias("value"))
    assert value(spark, Q.combined_stderr(F.array(part(0.5, 4, 1.0)))) == 0.5
    assert value(spark, Q.combined_stderr(F.slice(F.array(part(0.5, 4, 1.0)), 1, 0))) is None
    want = math.sqrt((3 * 0.25 + 2 * 0.04) / 6 + 12 / (7 * 6) * (13 / 7 - 3) ** 2)
    assert value(spark, Q.combined_stderr(F.array(part(0.5, 4, 1.0), part(0.2, 3, 3.0)))) == pytest.approx(want)
    box = lambda t: value(spark, Q.largest_box(F.lit(t)))
    assert box("none") is None and box(None) is None and box("[]") is None
    assert box('a [{"bbox": [0,0,2,2], "label": "p"}, {"bbox_2d": [1,1,3,3], "label": "q"}]').label == "p"
    rows = spark.createDataFrame([("s", 1.0, 3.0), ("s", 1.0, None), ("t", 1.0, 1.0)], "sec string, g double, p double")
    assert [(r.sec, r.avg_error, r.std_error, r.n) for r in Q.section_errors(rows, "sec", "g", "p").collect()] == [("s", 2.0, None, 2)]


def test_means_are_the_same_in_any_order(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (None,), (0.7,)] * 40, "v double")
    got = {df.repartition(n).agg(M.mean(F.col("v")).alias("m")).first()["m"] for n in (1, 3, 8)}
    assert got == {0.325}
    assert df.where("false").agg(M.mean(F.col("v")).alias("m")).first()["m"] is None
    big = spark.createDataFrame([(1e30,), (3e30,)], "v double").agg(M.mean(F.col("v")).alias("m")).first()["m"]
    small = spark.createDataFrame([(1e-20,), (3e-20,)], "v double").agg(M.mean(F.col("v")).alias("m")).first()["m"]
    assert big == pytest.approx(2e30) and small == pytest.approx(2e-20)


def test_tracks(spark):
    two = lambda t: tuple(value(spark, R.two_answers(F.lit(t))))
    assert (two("Yes <SEP> No"), two("hi yes, YES no"), two("yes"), two(""), two("a <SEP> b <SEP> c")) == (("Yes", "No"), ("YES", "YES"), ("YES", None), (None, None), (None, None))
    assert tuple(value(spark, R.label_flags(F.lit(" Transport")))) == (True, True) and tuple(value(spark, R.label_flags(F.lit(None).cast("string")))) == (None, None)
    with pytest.raises(Exception, match="unknown label"):
        value(spark, R.label_flags(F.lit("dance")))
    seg = lambda t, a, b: F.struct(F.lit(t).alias("text"), F.lit(float(a)).alias("t0"), F.lit(float(b)).alias("t1"))
    assert value(spark, R.results_of_output(F.slice(F.array(seg("x", 0, 1)), 1, 0), ["idle"])) == ""
    assert value(spark, R.results_of_output(F.array(seg("idle idle", 0, 4)), ["idle"])) == "idle@0.000;idle@2.000;idle@4.000"
    df = spark.createDataFrame([("v", 0, None), ("v", 1, "fast"), ("v", 2, "abstain"), ("v", 3, "still")], "id string, t int, s string")
    out = R.pose_states(df, ["id"], ["t"], "s", F.lit(False), F.lit(True), F.lit(False)).orderBy("t").collect()
    assert [r.label for r in out] == ["transport", "transport", "idle", "stabilize"]


def test_names(spark):
    name = lambda a: value(spark, N.model_name(F.lit(a)))
    assert (name("path=p,pretrained=q,x=1"), name("x=1"), name(None), name("peft=a")) == ("q", "", None, "a")
    lit = lambda a: value(spark, N.literal(F.lit(a)))
    assert (lit("12")["number"], lit("[]")["items"], lit("['a, b', 3]")["items"], lit("x")["kind"], lit(None)) == (12, [], ["a, b", "3"], "str", None)
    assert value(spark, N.watched_side(F.lit("R"), F.lit("Left"))) == "H" and value(spark, N.watched_side(F.lit("X"), F.lit("Left"))) is None
    assert value(spark, N.name_list(F.lit(""))) == [] and [tuple(x) for x in value(spark, N.name_list(F.lit("b|x\na")))] == [("b", "x"), ("a", "a")]
    assert contraction_table()["couldn'tve"] == "couldn't've" and "lets" not in contraction_table()


def test_natural_keys(spark):
    names = ["m1234567890123", "m1234567890129", "m2", "m10", "m010", "M3", ""]
    df = spark.createDataFrame([(x,) for x in names] + [(None,)], "x string").select("x", P.natural_key(F.col("x")).alias("k")).where("x IS NOT NULL").orderBy("k", "x")
    assert [r.x for r in df.collect()] == ["", "m2", "M3", "m010", "m10", "m1234567890123", "m1234567890129"]


def test_fewshot_per_document(spark):
    docs = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc bigint")
    pool = spark.createDataFrame([(i,) for i in range(0, 400, 2)], "shot bigint")
    got = {}
    for r in P.fewshot(docs, "doc", pool, "shot", 3, 1).collect():
        got.setdefault(r.doc, []).append((r.shot_no, r.shot))
    assert len(got) == 200 and all(len(v) == 3 == len({s for _, s in v}) and k not in {s for _, s in v} for k, v in got.items())
    assert len({tuple(sorted(s for _, s in v)) for v in got.values()}) > 150  # each document has its own
    few = P.fewshot(docs.where("doc < 2"), "doc", pool.where("shot < 3"), "shot", 3, 1).collect()
    assert {(r.doc, r.shot) for r in few} == {(0, 2), (1, 0), (1, 2)} and P.fewshot(docs, "doc", pool.where("false"), "shot", 3, 1).count() == 0


def test_rollups_of_any_depth(spark):
    edges = spark.createDataFrame([(f"g{i}", f"g{i + 1}") for i in range(12)] + [("a", "b"), ("b", "a")], "parent string, node string")
    scores = spark.createDataFrame([("g12", "m", 0.5, 0.1, 4)], "node string, metric string, value double, stderr double, n int")
    assert {r.group for r in M.rollup_groups(scores, edges).collect()} == {f"g{i}" for i in range(12)}
    assert {r.group: r.value for r in M.rollup_groups(scores, edges, weighted=False).collect()}["g0"] == 0.5


def test_rollups_dont_depend_on_the_order_of_leaves(spark):
    """The whole's value is 2995.11 / 60000, midway between two values of six places."""
    cents = [2950 + i % 90 for i in range(99)]
    leaves = [(f"s{i}", c / 100, 541 + i) for i, c in enumerate(cents)]
    leaves.append(("s99", (299_511 - sum(cents)) / 100, 60_000 - sum(n for _, _, n in leaves)))
    edges = spark.createDataFrame([("all", s) for s, _, _ in leaves], "parent string, node string")
    orders = [random.Random(seed).sample(leaves, len(leaves)) for seed in range(8)]
    rows = [(s, f"m{k}", v / n, 0.1, n) for k, order in enumerate(orders) for s, v, n in order]
    scores = spark.createDataFrame(rows, "node string, metric string, value double, stderr double, n int").coalesce(1)
    assert {r.value for r in M.rollup_groups(scores, edges).collect()} == {2995.11 / 60_000}


def test_sequence_hash(spark):
    import hashlib

    df = spark.createDataFrame([("t", 2, "b"), ("t", 1, "a"), ("t", 3, None), ("u", 1, None), (None, 1, "z")], "task string, i int, d string")
    got = {r.task: r.hash for r in M.sequence_hash(df, ["task"], ["i"], "d").collect()}
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {"t": h("ab"), "u": h(""), None: h("z")} and M.sequence_hash(df.where("false"), ["task"], ["i"], "d").count() == 0


def test_ranges_of_equal_rows(spark):
    df = spark.createDataFrame([("hot", float(i)) for i in range(500)] + [("hot", 1e12), ("b", 0.0), (None, 1.0)], "k string, v double")
    rows = ranged(df, ["k", "v"])
    sizes = [r["count"] for r in rows.groupBy(RANGE).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200  # neither the hot key nor one far value gathers rows in one range
    placed = running_total(rows, ["k"], F.col(RANGE), ["v"], F.lit(1), "n").where("k = 'hot'").orderBy("v").collect()
    assert [r.n for r in placed] == list(range(1, 502))
    assert running_total(ranged(df.where("false"), ["k", "v"]), ["k"], F.col(RANGE), ["v"], F.lit(1), "n").count() == 0


def test_groups(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("b", 1, None), (None, 1, 1.0)], "k string, i int, v double")
    assert {(r.k, r.v) for r in GR.first_values(df, ["k"], "i", ["v"]).collect()} == {("a", 2.0), ("b", None), (None, 1.0)}
    assert {(r.k, r.i) for r in GR.nth_rows(df, ["k"], ["i"], 1).collect()} == {("a", 2)}
    assert {(r.k, r.i) for r in GR.preferred_rows(df, ["k"], [-F.col("i")]).collect()} == {("a", 2), ("b", 1), (None, 1)}
    assert {(r.k, r.mode, r.mode_n) for r in GR.modes(df, ["k"], "v").collect()} == {("a", 2.0, 1), (None, 1.0, 1)}
    marks = spark.createDataFrame([("s", "x"), ("s", "x"), ("s", "q")], "s string, item string")
    items = spark.createDataFrame([("x",), ("y",)], "item string")
    (row,) = GR.audit(marks.select("s"), items, marks, ["s"], ["item"]).collect()
    assert (row.missing, row.repeated, row.unknown) == (1, 1, 1)
    win = lambda n, size, shared: value(spark, GR.rolling_windows(F.sequence(F.lit(1), F.lit(n)), size, shared))
    assert win(5, 2, 0) == [[1, 2], [3, 4], [5]] and win(5, 3, 1) == [[1, 2, 3], [3, 4, 5]] and win(2, 3, 1) == [[1, 2]]
    wide = spark.createDataFrame([("a", 1, 2)], "key string, L int, R int")
    rows = spark.createDataFrame([("a", "R"), ("a", None), ("z", "L")], "k string, side string")
    out = GR.chosen_column(rows, wide, ("k", "key"), ["L", "R"], F.col("side"), "n").collect()
    assert {(r.k, r.side, r.n) for r in out} == {("a", "R", 2), ("a", None, 1), ("z", "L", None)}
    assert GR.majority_class(df.where("false"), "k").count() == 0


def test_geometry(spark):
    p = lambda x, y, c: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"), F.lit(c).cast("double").alias("conf"))
    hand = value(spark, G.hand_point(p(0, 0, 0.9), p(10, 10, 0.5), 0.5, F.lit(12), F.lit(100)))
    assert (hand.x, hand.y, hand.conf) == (11.0, 15.0, 0.5) and math.isnan(value(spark, G.hand_point(p(0, 0, 0.9), p(None, 1, 1), 0.5, F.lit(9), F.lit(9))).x)
    plan = value(spark, G.crop_plan(F.array(p(0, 0, 0.9), p(0, 0, 0.1)), F.lit(640), F.lit(480)))
    assert plan.status == "ABSTAIN" and plan.boxes[0].x2 == 640
    with pytest.raises(ValueError):
        G.crop_plan(F.array(), F.lit(1), F.lit(1), "round")


def test_slots_fall_back_to_what_they_held(spark):
    rows = [("v", 0, 1, 0.0), ("v", 0, 2, 50.0), ("v", 1, 1, 1.0), ("v", 1, 2, 90.0), ("v", 2, 9, 500.0), ("w", 0, 1, 50.0)]
    df = spark.createDataFrame([(k, f, b, x, 0.0, x + 10, 10.0) for k, f, b, x in rows], "id string, frame int, box int, x1 double, y1 double, x2 double, y2 double")
    got = {tuple(r) for r in K.bind_slots(df, "id", [(50.0, 0.0, 60.0, 10.0), None]).collect()}
    assert got == {("v", 0, 0, 2), ("w", 0, 0, 1)}
    near = {tuple(r) for r in K.bind_slots(df, "id", [(0.0, 0.0, 10.0, 10.0)]).collect()}
    assert near == {("v", 0, 0, 1), ("v", 1, 0, 1)}


def test_sequences_and_joins(spark):
    marks = spark.createDataFrame([("v", 5, "x"), ("v", 9, "y")], "id string, t int, label string")
    probes = spark.createDataFrame([("v", 0, 1), ("v", 1, 7), ("w", 2, 3)], "id string, probe_id int, t int")
    got = {(r.probe_id, r.label) for r in asof_join(probes, marks, ["id"], "t", "label", clamp=True).collect()}
    assert got == {(0, "x"), (1, "x"), (2, None)}
    rows = spark.createDataFrame([("v", 0.0, "l_reach"), ("v", 1.0, "reach_2"), ("v", 2.0, "talk"), ("v", 3.0, "Reach"), ("v", 4.0, "rest"), ("v", 6.0, None)], "id string, t double, m string")
    assert [(r.label, r.t0, r.duration) for r in S.marker_intervals(rows, ["id"], ["t"], "t", "m").orderBy("t0").collect()] == [("reach", 0.0, 4.0), ("idle", 4.0, 2.0)]
    x = value(spark, S.count_errors(arr("a", "b"), arr("a", "a"), ["a", "b"]))
    assert (x.errors, x["mean"]) == ({"a": 1, "b": 1}, 1.0)


def test_statistics(spark):
    df = spark.createDataFrame([(3, 1, 1, 3), (0, 0, 0, 0), (None, 1, 1, 1)], "a int, b int, c int, d int")
    got = [r.p for r in Z.fisher_tests(df, "a", "b", "c", "d").orderBy(F.col("a").desc_nulls_last()).collect()]
    assert got[0] == pytest.approx(0.485714, abs=1e-6) and got[1] == 1.0 and got[2] is None
    assert value(spark, Z.slope_p(F.lit(1.96), F.lit(1.0))) == pytest.approx(0.05, abs=1e-4)
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 20), ("b", "y", 10)], "r string, c string, n int")
    row = Z.chi_square_test(cells, "r", "c", "n").first()
    assert row.chi2 == pytest.approx(6.666667, abs=1e-6) and row.p == pytest.approx(0.009823, abs=1e-6)


def test_words_and_edits():
    assert cut_words("a,b 1,000.") == ["a", ",", "b", "1,000", "."] and cut_words("3-4 &quot;x&quot; (y)\n") == ["3", "-", "4", '"', "x", '"', "(", "y", ")"]
    assert edit_distance([], []) == 0 and edit_distance("kitten", "sitting") == 3 and edit_distance("a" * 500, "b" * 300) == 500


def test_files(spark, tmp_path):
    for i, lines in enumerate((['{"a": 1}', "", '{"a": 2}'], ['{"a": 3}'])):
        (tmp_path / f"f{i}.jsonl").write_text("\n".join(lines) + "\n")
    rows = L.read_jsonl_strict(spark, str(tmp_path), "a int").collect()
    assert {(r.file[-8:], r.line_no, r.a) for r in rows} == {("f0.jsonl", 1, 1), ("f0.jsonl", 3, 2), ("f1.jsonl", 1, 3)}
    (tmp_path / "f2.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="line 2"):
        L.read_jsonl_strict(spark, str(tmp_path), "a int").collect()
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
        big = tmp_path / "big"
        big.mkdir()
        (big / "x.txt").write_text("".join(f"row {i}\n" for i in range(100)))
        assert {(r.line_no, r.value) for r in L.numbered_lines(spark, str(big)).collect()} == {(i + 1, f"row {i}") for i in range(100)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    runs = tmp_path / "runs" / "model_a"
    runs.mkdir(parents=True)
    (runs / "20240101_101010_results.json").write_text(json.dumps({"results": {"t": {"a,none": 1}}}))
    (runs / "20240102_101010_results.json").write_text("{broken")
    (row,) = L.scan_results(spark, str(tmp_path / "runs")).collect()
    assert (row.folder, row.stamp, json.loads(row.results)) == ("model_a", "20240101_101010", {"t": {"a,none": 1}})


def test_result_documents(spark):
    rows = spark.createDataFrame([("r", "t\"x", "none", "acc", 0.5, None, 3), ("r", "u", "none", "acc", 1.0, 0.1, 2)], "run string, task string, filter string, metric string, value double, stderr double, n bigint")
    (row,) = L.results_document(rows, ["run"]).collect()
    assert json.loads(row.document) == {"results": {"t\"x": {"acc,none": 0.5, "acc_stderr,none": None}, "u": {"acc,none": 1.0, "acc_stderr,none": 0.1}}, "n-samples": {"t\"x": 3, "u": 2}}


def test_declarations(tmp_path):
    T.register(T.FUNCTIONS, "test.load")(lambda spark, folder: None)
    (tmp_path / "t.json").write_text(json.dumps([{"task": "test_one", "dataset": "!function test.load", "doc_to_text": "x", "doc_to_target": "y", "tag": "test_tag", "output_type": "multiple_choice", "metric_list": [{"metric": "exact_match", "ignore_case": True}]},
                                                 {"task": "test_two", "include": "test_one", "repeats": 2}, {"group": "test_group", "task": ["test_one", "test_tw*"]}]))
    T.read_declarations(str(tmp_path / "t.json"))
    assert T.resolve(["test_tag"]) == ["test_one"] and T.resolve(["test_group"]) == ["test_one", "test_two"]
    assert T.TASKS["test_two"].repeats == 2 and T.TASKS["test_two"].args == {"exact_match": {"ignore_case": True}}
    for bad in ({"task": "test_one"}, {"task": "test_x", "dataset": "!function nowhere"}):
        with pytest.raises((ValueError, TypeError)):
            T.declare({"doc_to_text": "", "doc_to_target": "", **bad, **({} if "dataset" in bad else {"dataset": "!function test.load"})})
    (tmp_path / "t.yaml").write_text("task: test_yaml\ndataset: !function test.load\ndoc_to_text: a\ndoc_to_target: b\n")
    pytest.importorskip("yaml")
    (task,) = T.read_declarations(str(tmp_path / "t.yaml"))
    assert task.metrics == (("exact_match", "mean"),) and task.load(None, "") is None


def test_tracks_stream_as_one_tracker_per_video_gives_them(spark):
    import random

    rng = random.Random(6)
    rows = [(k, f, b, float(rng.randint(0, 12)), 0.0) for k in "ab" for f in rng.sample(range(60), 25) for b in range(rng.randint(1, 3))]
    df = spark.createDataFrame([(*r, r[3] + 5, 4.0) for r in rows], "id string, frame int, box int, x1 double, y1 double, x2 double, y2 double")
    want = set()
    for k in "ab":
        tracker, last = K.Tracker(0.3, 4), None
        for frame in sorted({r[1] for r in rows if r[0] == k}):
            for _ in range(frame - last - 1 if last is not None else 0):
                tracker.frame([])
            boxes = sorted(r for r in rows if r[0] == k and r[1] == frame)
            want |= {(k, frame, r[2], t) for r, t in zip(boxes, tracker.frame([(r[3], 0.0, r[3] + 5, 4.0) for r in boxes]))}
            last = frame
    assert {tuple(r) for r in K.track_boxes(df, "id", 0.3, 4).collect()} == want
