"""Queries on crops, hands, window flags, marker intervals, tests of counts, files and chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksift.functions import geometry as G
from tracksift.operators import interval_joins as J
from tracksift.operators import sequences as S
from tracksift.operators import stats as Z
from tracksift.operators import windows as W
from tracksift.plans.catalog import half_up, query, sql_mean
from tracksift.plans.catalog_choices import _SEGS, _segs
from tracksift.plans.catalog_sequences import EV, LABELS, events
from tracksift.session import new_path
from tracksift.sources import logs as L
from tracksift.sources.tables import log_rows, table

_CROP = "greatest(round_even(greatest(112.0, least({1} - 112, {0})), 0) - 112, 0)::INT"


def _hands(spark, sf_dir):
    """Five frames of a hand that moves by its record's numbers."""
    rows = table(spark, sf_dir, "fp_metadata").where("width IS NOT NULL AND height IS NOT NULL")
    n = F.col("rec_no")
    point = lambda i: F.struct((F.lit(100.0) + i * (n % 90)).alias("x"), (F.lit(200.0) + i * (n % 7)).alias("y"), F.when((n % 5 == 0) & (F.lit(i) == 4), 0.1).otherwise(0.9).alias("conf"))
    return rows.select("rec_no", "width", "height", F.array(*[point(i) for i in range(5)]).alias("p"))


@query(f"""
    WITH h AS (SELECT rec_no, width AS w, height AS h, rec_no % 90 AS d, rec_no % 5 = 0 AS lost, mode, i FROM fp_metadata, (SELECT unnest(['middle', 'linear', 'individual', 'mixed']) AS mode), range(5) t(i) WHERE width IS NOT NULL AND height IS NOT NULL),
    c AS (SELECT *, CASE WHEN mode = 'middle' OR (mode = 'mixed' AND d < 50) THEN (100.0 + 100.0 + 4 * d) / 2 ELSE 100.0 + i * d END AS x FROM h)
    SELECT rec_no, mode, CAST(i AS INTEGER) AS frame, CASE WHEN lost THEN 'ABSTAIN' WHEN d >= 50 AND mode <> 'individual' THEN 'FAST' WHEN mode = 'individual' AND d >= 50 THEN 'FAST' ELSE 'OK' END AS status, CASE WHEN lost THEN 0 ELSE {_CROP.format("x", "w")} END AS x1 FROM c
""")
def crop_modes(spark, sf_dir):
    rows = _hands(spark, sf_dir)
    out = None
    for mode in ("middle", "linear", "individual", "mixed"):
        plan = G.crop_plan(F.col("p"), F.col("width"), F.col("height"), mode)
        one = rows.select("rec_no", F.lit(mode).alias("mode"), plan.alias("c")).select("rec_no", "mode", F.col("c.status").alias("status"), F.posexplode("c.boxes").alias("frame", "b"))
        one = one.select("rec_no", "mode", "frame", "status", F.col("b.x1").alias("x1"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    SELECT rec_no, CASE WHEN rec_no % 4 = 0 THEN -1.0 ELSE greatest(least(round_even(10.0 + (rec_no % 50 - 10.0) * 1.5, 0), width - 1.0), 0.0) END AS x, CASE WHEN rec_no % 4 = 0 THEN 0.0 ELSE 0.5 END AS conf FROM fp_metadata WHERE width IS NOT NULL AND height IS NOT NULL
""")
def hand_points(spark, sf_dir):
    """A hand that can't be told is NaN (given here as -1) with confidence 0."""
    n = F.col("rec_no")
    elbow = F.struct(F.lit(10.0).alias("x"), F.lit(5.0).alias("y"), F.lit(0.5).alias("conf"))
    wrist = F.struct((n % 50).cast("double").alias("x"), F.when(n % 4 == 0, float("nan")).otherwise(9.0).alias("y"), F.lit(0.8).alias("conf"))
    rows = table(spark, sf_dir, "fp_metadata").where("width IS NOT NULL AND height IS NOT NULL").select("rec_no", G.hand_point(elbow, wrist, 0.5, F.col("width"), F.col("height")).alias("h"))
    return rows.select("rec_no", F.when(F.isnan("h.x"), -1.0).otherwise(F.col("h.x")).alias("x"), F.col("h.conf").alias("conf"))


@query("""
    WITH m AS (SELECT DISTINCT ON (marker_id) marker_id, id, Time_s, MarkerNames FROM label_track WHERE id IS NOT NULL AND Time_s IS NOT NULL),
    l AS (SELECT *, max(Time_s) OVER (PARTITION BY id) AS fin, CASE WHEN contains(MarkerNames, 'reach') THEN 'reach' WHEN contains(MarkerNames, 'reposition') OR contains(MarkerNames, 'retract') THEN 'reposition' WHEN contains(MarkerNames, 'transport') THEN 'transport' WHEN contains(MarkerNames, 'stabilize') THEN 'stabilize' WHEN contains(MarkerNames, 'idle') OR contains(MarkerNames, 'rest') THEN 'idle' END AS label FROM m),
    k AS (SELECT *, lag(label) OVER (PARTITION BY id ORDER BY Time_s, marker_id) AS p FROM l WHERE label IS NOT NULL),
    c AS (SELECT * FROM k WHERE p IS NULL OR p <> label)
    SELECT id, label, Time_s AS t0, round(coalesce(lead(Time_s) OVER (PARTITION BY id ORDER BY Time_s, marker_id), fin) - Time_s, 6) AS duration FROM c
""")
def marker_intervals(spark, sf_dir):
    rows = log_rows(spark, sf_dir, "label_track", "id", "Time_s", "MarkerNames").where("id IS NOT NULL AND Time_s IS NOT NULL")
    out = S.marker_intervals(rows, ["id"], ["Time_s", "marker_id"], "Time_s", "MarkerNames")
    return out.select("id", "label", "t0", half_up(F.col("duration")).alias("duration"))


@query(f"""
    WITH s AS (SELECT * FROM {_SEGS} WHERE t1 > t0), w AS (SELECT DISTINCT user_id, t0 // 86400000 AS window_id FROM s),
    j AS (SELECT w.*, s.t0, s.t1, event_type AS l, event_type IN ('click', 'view') AS f FROM w JOIN s ON s.user_id = w.user_id AND t0 < (window_id + 1) * 86400000 AND window_id * 86400000 < t1),
    o AS (SELECT user_id, window_id, l, min(t0) AS a FROM j GROUP BY ALL), t AS (SELECT user_id, window_id, string_agg(l, ',' ORDER BY a, l) AS labels FROM o GROUP BY ALL)
    SELECT user_id, window_id, bool_or(CASE WHEN t0 <= (window_id + 0.5) * 86400000 AND (window_id + 0.5) * 86400000 < t1 THEN f END) AS middle, CASE WHEN bool_and(f) = bool_or(f) THEN bool_and(f) END AS whole, any_value(labels) AS labels
    FROM j JOIN t USING (user_id, window_id) GROUP BY user_id, window_id
""")
def window_flags(spark, sf_dir):
    s = _segs(spark, sf_dir).withColumnRenamed("event_type", "label")
    w = s.select("user_id", F.floor(F.col("t0") / 86_400_000).cast("bigint").alias("window_id")).distinct()
    w = w.select("user_id", "window_id", (F.col("window_id") * 86_400_000).alias("t0"), ((F.col("window_id") + 1) * 86_400_000).alias("t1"))
    out = S.window_flags(w, s.withColumn("flag", F.col("label").isin("click", "view")), ["user_id"], "flag")
    return out.select("user_id", "window_id", "middle", "whole", F.array_join("labels", ",").alias("labels"))


@query(f"""
    WITH p AS (SELECT user_id, unnest([1704067200000, 1705276800000, 1800000000000]) AS t FROM (SELECT DISTINCT user_id FROM events)),
    f AS (SELECT user_id, min_by(event_type, (t, event_type)) AS first FROM {EV} GROUP BY user_id)
    SELECT p.user_id, p.t, coalesce((SELECT max_by(event_type, (e.t, event_type)) FROM {EV} e WHERE e.user_id = p.user_id AND e.t <= p.t), first) AS label FROM p JOIN f USING (user_id)
""")
def asof_clamped(spark, sf_dir):
    """Before the first mark its label, after the last one that."""
    marks = events(spark, sf_dir).select("user_id", "t", F.col("event_type").alias("label"))
    probes = marks.select("user_id").distinct().select("user_id", F.posexplode(F.array(*[F.lit(x) for x in (1704067200000, 1705276800000, 1800000000000)])).alias("probe_id", "t"))
    return J.asof_join(probes, marks, ["user_id"], "t", "label", clamp=True).select("user_id", "t", "label")


@query(f"""
    WITH s AS (SELECT 'late' AS side, event_type AS label, t1 - t0 AS d FROM {_SEGS} WHERE t1 > t0 AND t0 >= 1705276800000 UNION ALL SELECT 'early', event_type, t1 - t0 FROM {_SEGS} WHERE t1 > t0 AND t0 < 1705276800000)
    SELECT side, label, count(*) AS n, CAST(sum(d) AS BIGINT) AS total, round(sum(d) / count(*), 4) AS mean FROM s GROUP BY side, label
""")
def class_durations(spark, sf_dir):
    s = _segs(spark, sf_dir).withColumnRenamed("event_type", "label")
    out = S.class_durations({"late": s.where("t0 >= 1705276800000"), "early": s.where("t0 < 1705276800000")})
    return out.select("side", "label", "n", "total", half_up(F.col("mean"), 4).alias("mean"))


@query(f"""
    WITH c AS (SELECT user_id, event_type AS l, abs(count(*) FILTER (WHERE t >= 1705276800000) - count(*) FILTER (WHERE t < 1705276800000)) AS e FROM {EV} GROUP BY ALL)
    SELECT user_id, round(sum(e) / 5.0, 6) AS mean, CAST(coalesce(max(CASE WHEN l = 'view' THEN e END), 0) AS INTEGER) AS view FROM c GROUP BY user_id
""")
def count_errors(spark, sf_dir):
    """Counts of each label in a user's late events against the early ones."""
    late = F.col("t") >= 1705276800000
    seqs = events(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.when(late, F.col("event_type"))).alias("p"), F.collect_list(F.when(~late, F.col("event_type"))).alias("r"))
    out = seqs.select("user_id", S.count_errors(F.col("p"), F.col("r"), LABELS).alias("x"))
    return out.select("user_id", half_up(F.col("x.mean")).alias("mean"), F.try_element_at("x.errors", F.lit("view")).alias("view"))


@query("""
    WITH x AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'F') AS b,
      count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'F') AS c, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'F') AS d FROM lineitem GROUP BY l_suppkey),
    k AS (SELECT l_suppkey, a, b, c, d, unnest(range(greatest(0, c - (b + d) + a + 0 - (c - 0) + 0, (a + c) - (c + d)), least(a + b, a + c) + 1)) AS k FROM x),
    p AS (SELECT l_suppkey, a, k, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(c + d - (a + c) + k + 1) AS l FROM k),
    o AS (SELECT l_suppkey, l FROM p WHERE k = a)
    SELECT l_suppkey, round(least(1.0, sum(exp(p.l))), 6) AS p FROM p JOIN o USING (l_suppkey) WHERE p.l <= o.l + 1e-9 GROUP BY l_suppkey
""")
def stat_fisher(spark, sf_dir):
    r, f = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(r & f).alias("a"), F.count_if(r & ~f).alias("b"), F.count_if(~r & f).alias("c"), F.count_if(~r & ~f).alias("d"))
    return Z.fisher_tests(cells, "a", "b", "c", "d").select("l_suppkey", half_up(F.col("p")).alias("p"))


@query()
def stat_chi2_test(spark, sf_dir):
    """The statistic with its p-value, which SQL has no function for."""
    cells = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return Z.chi_square_test(cells, "o_orderstatus", "o_orderpriority", "n")


@query("SELECT rec_no, greatest(round_even(fps / 2.0, 0), 1)::INT AS stride FROM fp_metadata WHERE fps IS NOT NULL")
def win_stride(spark, sf_dir):
    return table(spark, sf_dir, "fp_metadata").where("fps IS NOT NULL").select("rec_no", W.frame_stride(F.col("fps"), 2.0).alias("stride"))


@query("""
    WITH m AS (SELECT rec_no, CAST(floor(duration_s * fps) AS BIGINT) AS n, greatest(floor(fps / 2.0), 1)::BIGINT AS s FROM fp_metadata WHERE duration_s IS NOT NULL AND fps IS NOT NULL),
    f AS (SELECT rec_no, n, CASE WHEN (n - 1) // s + 2 > 64 THEN list_transform(range(64), lambda i: i * (n - 1) // 63) ELSE list_distinct(list_append(range(0, n, s), n - 1)) END AS l FROM m WHERE n > 0)
    SELECT rec_no, array_to_string(list_sort(l), ',') AS frames FROM f
""")
def win_capped_frames(spark, sf_dir):
    """The frames themselves."""
    rows = table(spark, sf_dir, "fp_metadata").where("duration_s IS NOT NULL AND fps IS NOT NULL").select("rec_no", F.floor(F.col("duration_s") * F.col("fps")).alias("n"), "fps").where("n > 0")
    frames = F.array_sort(G.capped_frames(F.col("n"), F.col("fps"), 2.0, 64))
    return rows.select("rec_no", F.array_join(F.transform(frames, lambda x: x.cast("string")), ",").alias("frames"))


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS line_no, doc_id FROM documents")
def io_numbered_lines(spark, sf_dir):
    """JSON lines of one file read back with their numbers, by a reader that names a broken one."""
    path = new_path(spark, "lines")
    table(spark, sf_dir, "documents").select("doc_id").coalesce(1).orderBy("doc_id").select(F.to_json(F.struct("doc_id")).alias("value")).coalesce(1).write.text(path)
    return L.read_jsonl_strict(spark, path, "doc_id bigint").select("line_no", "doc_id")


@query("""
    WITH d AS (SELECT DISTINCT ON (run_no) run_no, results FROM run_log)
    SELECT run_no, len(json_keys(results)) AS n_tasks FROM d WHERE json_valid(results) AND json_type(TRY_CAST(results AS JSON)) = 'OBJECT'
""")
def io_scan_results(spark, sf_dir):
    """Result files of many folders, one row each; broken ones are skipped."""
    path = new_path(spark, "runs")
    rows = log_rows(spark, sf_dir, "run_log", "results").where("results IS NOT NULL")
    body = F.concat(F.lit('{"results":'), "results", F.lit("}"))
    rows.select(body.alias("value"), F.concat(F.lit("run_"), F.col("run_no").cast("string"), F.lit("_results.json")).alias("run")).repartition("run").write.partitionBy("run").text(path)
    found = L.scan_results(spark, path, "*")
    run = F.regexp_extract("folder", "run_([0-9]+)_", 1).cast("bigint")
    return found.where("results IS NOT NULL").select(run.alias("run_no"), F.size(F.map_keys(F.from_json("results", "map<string,string>"))).cast("bigint").alias("n_tasks"))


@query("SELECT string_split(path_v, '/')[-2] AS model, count(*) AS n_logs FROM fp_metadata WHERE path_v IS NOT NULL GROUP BY 1")
def io_models(spark, sf_dir):
    return L.models_with_logs(table(spark, sf_dir, "fp_metadata").where("path_v IS NOT NULL"), "path_v")


@query("""
    SELECT qid, 'turns' AS kind, 'system:Answer.|user:q1|assistant:a1|user:' || fm_video AS text FROM fm_item_questions UNION ALL SELECT qid, 'one', 'user:q1 a1' || chr(10) || chr(10) || fm_video FROM fm_item_questions
""")
def prompt_chat(spark, sf_dir):
    q = table(spark, sf_dir, "fm_item_questions")
    shots = F.array(F.struct(F.lit("q1").alias("question"), F.lit("a1").alias("answer")))
    text = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    turns = q.select("qid", F.lit("turns").alias("kind"), text(L.chat_messages(F.lit("Answer."), shots, F.col("fm_video"), True)).alias("text"))
    return turns.unionByName(q.select("qid", F.lit("one").alias("kind"), text(L.chat_messages(None, shots, F.col("fm_video"), False)).alias("text")))
