"""Queries on selections, scores against truths, tracks from answers, and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksift.functions import names as N
from tracksift.operators import metrics as M
from tracksift.operators import sampling as P
from tracksift.operators import scoring as Q
from tracksift.operators import selection as C
from tracksift.operators import state as K
from tracksift.operators import tracks as R
from tracksift.plans.catalog import half_up, query, sql_mean
from tracksift.plans.catalog_sequences import EV, events
from tracksift.sources.tables import log_rows, table

_ONE = "(SELECT sample_no, any_value(run_no) AS run_no, any_value(task) AS task, any_value(doc_id) AS doc_id, any_value(target) AS target, any_value(accuracy) AS accuracy, any_value(filtered_resps) AS r, any_value(qids) AS qids FROM sample_log GROUP BY sample_no)"


def r6(c, name):
    return half_up(c).alias(name)


# --- selections --------------------------------------------------------------


@query("""
    SELECT 'listed' AS kind, c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
    UNION ALL SELECT 'pattern', c_custkey FROM customer WHERE regexp_matches(c_mktsegment, 'TUR')
    UNION ALL SELECT 'all', c_custkey FROM customer UNION ALL SELECT 'without', c_custkey FROM customer WHERE NOT regexp_matches(c_mktsegment, '^A')
""")
def select_by_names(spark, sf_dir):
    """A list, a pattern that takes its place, all, and all but a pattern."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    kinds = {"listed": {"names": "BUILDING, MACHINERY"}, "pattern": {"names": "BUILDING", "pattern": "TUR"}, "all": {"names": "all"}, "without": {"without": "^A"}}
    out = [C.select_rows(c, "c_mktsegment", **kw).select(F.lit(k).alias("kind"), "c_custkey") for k, kw in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT rec_no FROM fp_metadata WHERE is_in_strokerehab_test_set")
def select_flagged(spark, sf_dir):
    """The flag's name comes from a parameter."""
    name = C.parameter(spark, "test_set", "in_strokerehab_test_set")
    return C.flagged(table(spark, sf_dir, "fp_metadata"), name, "is_").select("rec_no")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity <= 7 AND l_quantity + 4 >= 3) OR (l_quantity <= 30 AND l_quantity + 4 >= 28) OR (l_quantity <= 19 AND l_quantity + 4 >= 19)")
def select_ranges(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").where(C.range_overlap(q, q + 4, "3-7, 19,30-28")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n = 4")
def select_complete(spark, sf_dir):
    return C.complete_groups(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], 4)


@query("SELECT r_regionkey, r_name FROM region")
def drop_media(spark, sf_dir):
    """Bytes, alone or within others, go; the rest stays."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name").withColumn("image", F.encode("r_name", "UTF-8"))
    return C.without_media(rows.withColumn("media", F.array(F.struct(F.col("image").alias("bytes"), F.lit(1).alias("n")))))


@query("SELECT l_orderkey, l_linenumber, (l_returnflag, l_linestatus) IN (SELECT o_orderstatus, 'F' FROM orders UNION SELECT 'R', 'F') AS is_member FROM lineitem")
def join_member_flag(spark, sf_dir):
    others = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("l_returnflag"), F.lit("F").alias("l_linestatus"))
    others = others.unionByName(table(spark, sf_dir, "region").select(F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus")))
    return C.member_flag(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], others).select("l_orderkey", "l_linenumber", "is_member")


@query("""
    WITH x AS (SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN 'gt' ELSE 'pred' END AS side, l_quantity AS v FROM lineitem)
    SELECT g.k AS l_orderkey, v_gt, v_pred FROM (SELECT k, max(v) AS v_gt FROM x WHERE side = 'gt' GROUP BY k) g JOIN (SELECT k, max(v) AS v_pred FROM x WHERE side = 'pred' GROUP BY k) p ON g.k = p.k
""")
def join_both_sides(spark, sf_dir):
    side = F.when(F.col("l_returnflag") == "R", "gt").otherwise("pred")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", side.alias("side"), F.col("l_quantity").alias("v"))
    return C.both_sides(rows, ["l_orderkey"], "side", "v", ("gt", "pred"))


@query("SELECT n_nationkey, n_name AS name_1, n_comment AS name_2 FROM (SELECT n_nationkey, n_name, 'x' || n_regionkey AS n_comment FROM nation) UNION ALL SELECT n_nationkey, 'x' || n_regionkey, n_name FROM nation")
def union_swapped(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name_1"), F.concat(F.lit("x"), F.col("n_regionkey").cast("string")).alias("name_2"))
    return C.swapped_union(rows, "_1", "_2")


@query("""
    SELECT rec_no, id, string_agg(question_type, ' <SEP> ' ORDER BY qid) AS questions FROM fp_metadata
    JOIN fm_item_questions ON split_part(fm_video, '_', 1)::INT = rec_no % 33 GROUP BY rec_no, id
""")
def join_question_lists(spark, sf_dir):
    """Each video with its questions as one text, in the order of the file."""
    q = table(spark, sf_dir, "fm_item_questions").select(F.split("fm_video", "_")[0].cast("int").alias("item"), "qid", "question_type")
    lists = C.ordered_list(q, ["item"], "qid", "question_type", " <SEP> ").withColumnRenamed("question_type", "questions")
    return table(spark, sf_dir, "fp_metadata").join(lists, F.col("rec_no") % 33 == F.col("item")).select("rec_no", "id", "questions")


@query("SELECT sample_no, qid, CAST(b AS INTEGER) AS block, v || b AS value FROM (SELECT sample_no, unnest(['p', 'q', 'r']) AS qid, unnest(['x', 'y', 'z']) AS v FROM (SELECT DISTINCT sample_no FROM sample_log)), range(2) t(b)")
def transpose_blocks(spark, sf_dir):
    """Two blocks of three answers become three questions of two answers."""
    block = lambda i: F.array(*[F.lit(f"{x}{i}") for x in "xyz"])
    rows = log_rows(spark, sf_dir, "sample_log", "task").select("sample_no", C.transposed_blocks(F.array(block(0), block(1)), F.array(*map(F.lit, "pqr"))).alias("x"))
    return rows.select("sample_no", F.inline("x"))


@query("SELECT model_name, CAST(row_number() OVER (ORDER BY lower(regexp_extract(model_name, '^([A-Za-z]+)', 1)), coalesce(TRY_CAST(replace(lower(regexp_extract(model_name, '(?i)([0-9]+(?:[p.][0-9]+)?)b([^a-z]|$)', 1)), 'p', '.') AS DOUBLE), -1), model_name) AS INTEGER) AS place FROM (SELECT DISTINCT model_name FROM run_log WHERE model_name IS NOT NULL)")
def sort_models(spark, sf_dir):
    """Names by family and size; few, so a window over all of them is small."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "run_log").select("model_name").where("model_name IS NOT NULL").distinct()
    return rows.select("model_name", F.row_number().over(Window.orderBy(*P.model_order(F.col("model_name")))).alias("place"))


@query("SELECT DISTINCT lower(trim(activity)) AS sort_key, activity FROM fp_metadata WHERE activity IS NOT NULL")
def sort_folded(spark, sf_dir):
    return table(spark, sf_dir, "fp_metadata").where("activity IS NOT NULL").select(P.folded_key(F.col("activity")).alias("sort_key"), "activity").distinct()


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS place, o_totalprice AS answer FROM orders")
def reorder_restore(spark, sf_dir):
    """Sorted by price within partitions, answered, and back in order."""
    asked = P.reordered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    answered = asked.withColumn("answer", F.col("o_totalprice")).withColumn("place", F.col("_place").cast("bigint"))
    return P.restored(answered).select("o_orderkey", "place", "answer")


@query("SELECT s_suppkey, CAST(r - 1 AS INTEGER) AS shot_no, p_partkey FROM supplier, (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part) WHERE r <= 2")
def fewshot_first(spark, sf_dir):
    return P.first_n(table(spark, sf_dir, "supplier"), "s_suppkey", table(spark, sf_dir, "part"), "p_partkey", 2)


# --- scores ------------------------------------------------------------------


@query(f"""
    SELECT sample_no, CAST(target IN ('drinking', 'feeding') OR target = 'shelf' AS INTEGER)::DOUBLE AS any_match, greatest(CAST(target = 'drinking' AS INT), CAST(target = 'feeding' AS INT), CAST(target = 'shelf' AS INT))::DOUBLE AS best FROM {_ONE} WHERE target IS NOT NULL
""")
def metric_several_truths(spark, sf_dir):
    golds = F.array(*map(F.lit, ("drinking", "feeding", "shelf")))
    score = lambda g: M.exact_match(F.col("target"), g)
    return log_rows(spark, sf_dir, "sample_log", "target").where("target IS NOT NULL").select("sample_no", Q.any_match(golds, score).alias("any_match"), Q.max_over(golds, score).alias("best"))


@query("SELECT vec_id, (-embedding[1])::DOUBLE AS perplexity, CAST(embedding[1] > embedding[2] AS INT)::DOUBLE AS acc FROM embeddings")
def metric_loglikelihood(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a, b = F.get("embedding", 0), F.get("embedding", 1)
    return e.select("vec_id", *Q.loglikelihood_scores(-a, a > b))


@query("""
    WITH x AS (SELECT qid, ['binary', 'categorical', 'count'] AS c, CASE qid % 5 WHEN 0 THEN 'count' WHEN 1 THEN '1' WHEN 2 THEN '[0, 2]' WHEN 3 THEN '7' ELSE 'zzz' END AS g FROM fm_item_questions)
    SELECT qid, CASE qid % 5 WHEN 0 THEN '2' WHEN 1 THEN '1' WHEN 2 THEN '0,2' ELSE '-100' END AS positions FROM x
""")
def metric_gold_positions(spark, sf_dir):
    q = F.col("qid") % 5
    gold = F.when(q == 0, "count").when(q == 1, "1").when(q == 2, "[0, 2]").when(q == 3, "7").otherwise("zzz")
    found = Q.gold_positions(gold, F.array(*map(F.lit, ("binary", "categorical", "count"))))
    return table(spark, sf_dir, "fm_item_questions").select("qid", F.array_join(F.transform(found, lambda i: i.cast("string")), ",").alias("positions"))


@query(f"""
    WITH p AS (SELECT task, doc_id % 7 AS q, run_no AS p, min(coalesce((accuracy > 0.2)::INT, 0)) AS a FROM {_ONE} GROUP BY ALL), q AS (SELECT task, q, min(a) AS m, sum(a) AS s, count(*) AS n FROM p GROUP BY task, q)
    SELECT task, round(sum(s) / sum(n)::DOUBLE, 6) AS acc_all, round(stddev_samp(m) / sqrt(count(m)), 6) AS stderr FROM q GROUP BY task
""")
def agg_all_right(spark, sf_dir):
    rows = log_rows(spark, sf_dir, "sample_log", "task", "doc_id", "run_no", "accuracy").select("task", (F.col("doc_id") % 7).alias("q"), F.col("run_no").alias("p"), (F.col("accuracy") > 0.2).alias("right"))
    out = Q.all_right(rows, ["task"], "p", "q", "right")
    return out.select("task", r6(F.col("acc_all"), "acc_all"), r6(F.col("stderr"), "stderr"))


@query(f"""
    WITH RECURSIVE t AS (SELECT l_returnflag AS g, l_linenumber AS i, {sql_mean("l_discount")} AS m, stddev_samp(l_discount) / sqrt(count(*)) AS se, count(*) AS n FROM lineitem GROUP BY ALL),
    f AS (SELECT g, i, se * se AS v, n::DOUBLE AS n, m FROM t WHERE i = 1
      UNION ALL SELECT t.g, t.i, ((f.n - 1) * f.v + (t.n - 1) * t.se * t.se) / (f.n + t.n - 1) + f.n * t.n / ((f.n + t.n) * (f.n + t.n - 1)) * pow((f.m * f.n + t.m * t.n) / (f.n + t.n) - t.m, 2), f.n + t.n, (f.m * f.n + t.m * t.n) / (f.n + t.n) FROM f JOIN t ON t.g = f.g AND t.i = f.i + 1)
    SELECT g AS l_returnflag, round(sqrt(arg_max(v, i)), 6) AS combined FROM f GROUP BY g
""")
def agg_combined_se(spark, sf_dir):
    v = F.col("l_discount")
    per = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(M.mean(v).alias("value"), M.stderr(v).alias("se"), F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "se", "n", "value"))), lambda x: F.struct(x["se"].alias("se"), x["n"].alias("n"), x["value"].alias("value")))
    return per.groupBy("l_returnflag").agg(parts.alias("p")).select("l_returnflag", r6(Q.combined_stderr(F.col("p")), "combined"))


@query(f"SELECT task, round(sum(w * accuracy) / sum(w), 6) AS weighted FROM (SELECT task, accuracy, doc_id % 5 + 1 AS w FROM {_ONE}) WHERE accuracy IS NOT NULL GROUP BY task")
def agg_weighted_accuracy(spark, sf_dir):
    rows = log_rows(spark, sf_dir, "sample_log", "task", "doc_id", "accuracy")
    return rows.groupBy("task").agg(r6(Q.weighted_by(F.col("accuracy"), F.col("doc_id") % 5 + 1), "weighted")).where("weighted IS NOT NULL")


@query(f"""
    WITH x AS (SELECT task, len(list_filter(string_split(array_to_string(r, ';'), ';'), lambda p: contains(p, '@'))) AS a, len(list_filter(string_split(target, ';'), lambda p: contains(p, '@'))) AS b FROM {_ONE} WHERE r IS NOT NULL AND target IS NOT NULL)
    SELECT task, round(avg(a / b::DOUBLE), 6) AS ratio FROM x WHERE b > 0 GROUP BY task
""")
def agg_count_ratio(spark, sf_dir):
    rows = log_rows(spark, sf_dir, "sample_log", "task", "filtered_resps", "target").where("filtered_resps IS NOT NULL AND target IS NOT NULL")
    ratio = Q.count_ratio(F.array_join("filtered_resps", ";"), F.col("target"))
    return rows.groupBy("task").agg(r6(F.avg(ratio), "ratio")).where("ratio IS NOT NULL")


@query(f"""
    WITH x AS (SELECT o_orderpriority AS section, abs(o_totalprice - CASE WHEN o_orderkey % 10 <> 0 THEN 100000.0 END) AS e FROM orders)
    SELECT section, round({sql_mean("e")}, 4) AS avg_error, round(stddev_samp(e) / sqrt(count(*)), 4) AS std_error, count(*) AS n FROM x GROUP BY section HAVING count(*) >= 2
""")
def agg_section_errors(spark, sf_dir):
    pred = F.when(F.col("o_orderkey") % 10 != 0, F.lit(100000.0))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("section"), F.col("o_totalprice").alias("gold"), pred.alias("pred"))
    out = Q.section_errors(rows, "section", "gold", "pred")
    return out.select("section", half_up(F.col("avg_error"), 4).alias("avg_error"), half_up(F.col("std_error"), 4).alias("std_error"), "n")


@query(f"""
    WITH p AS (SELECT l_returnflag AS cohort, l_orderkey % 50 AS k, sum(abs(l_quantity - l_linenumber)) / sum(l_quantity) AS rce FROM lineitem GROUP BY ALL)
    SELECT cohort, round({sql_mean("rce")}, 6) AS mean_rce, round(stddev_samp(rce) / sqrt(count(rce)), 6) AS sem_rce, count(rce) AS n FROM p GROUP BY cohort
""")
def agg_cohort_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cohort"), (F.col("l_orderkey") % 50).alias("k"), F.col("l_linenumber").alias("pred"), F.col("l_quantity").alias("true"))
    out = Q.cohort_errors(rows, "cohort", "k", "pred", "true")
    return out.select("cohort", r6(F.col("mean_rce"), "mean_rce"), r6(F.col("sem_rce"), "sem_rce"), "n")


_SEGS = f"(SELECT user_id, t AS t0, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS t1, event_type FROM {EV})"


def _segs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return events(spark, sf_dir).select("user_id", F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), "event_type").where("t1 > t0")


@query(f"""
    WITH s AS (SELECT * FROM {_SEGS} WHERE t1 > t0), w AS (SELECT DISTINCT user_id, t0 // 86400000 AS window_id, t0 // 86400000 * 86400000 AS a, (t0 // 86400000 + 1) * 86400000 AS b FROM s),
    j AS (SELECT w.*, s.t0, s.t1, event_type IN ('click', 'view') AS f, least(b, t1) - greatest(a, t0) AS d, CASE WHEN window_id % 3 > 0 THEN window_id % 3 = 1 END AS p FROM w JOIN s ON s.user_id = w.user_id AND t0 < b AND a < t1),
    m AS (SELECT *, max(CASE WHEN t0 <= (a + b) / 2.0 AND (a + b) / 2.0 < t1 THEN f::INT END) OVER (PARTITION BY user_id, window_id) AS mid FROM j)
    SELECT user_id, window_id, round(sum(CASE WHEN mid IS NOT NULL THEN CASE WHEN f::INT = mid THEN d ELSE 0 END END) / sum(CASE WHEN mid IS NOT NULL THEN d END)::DOUBLE, 6) AS oracle,
      round(sum(CASE WHEN p IS NOT NULL THEN CASE WHEN f = p THEN d ELSE 0 END END) / sum(CASE WHEN p IS NOT NULL THEN d END)::DOUBLE, 6) AS model FROM m GROUP BY user_id, window_id
""")
def window_frame_accuracy(spark, sf_dir):
    s = _segs(spark, sf_dir)
    day = F.floor(F.col("t0") / 86_400_000).cast("bigint")
    w = s.select("user_id", day.alias("window_id")).distinct()
    w = w.select("user_id", "window_id", (F.col("window_id") * 86_400_000).alias("t0"), ((F.col("window_id") + 1) * 86_400_000).alias("t1"), F.when(F.col("window_id") % 3 > 0, F.col("window_id") % 3 == 1).alias("pred"))
    out = Q.window_accuracy(w, s.withColumn("flag", F.col("event_type").isin("click", "view")), ["user_id"], "flag", "pred")
    return out.select("user_id", "window_id", r6(F.col("oracle"), "oracle"), r6(F.col("model"), "model"))


@query("""
    SELECT rec_no, CASE WHEN rec_no % 4 = 0 THEN NULL WHEN rec_no % 4 = 3 THEN 'small' ELSE 'hand' END AS label, CASE WHEN rec_no % 4 = 0 THEN NULL WHEN rec_no % 4 = 3 THEN 1.0 ELSE rec_no % 100 + 9.0 END AS x2 FROM fp_metadata
""")
def detection_box(spark, sf_dir):
    """The larger of two boxes, spelled in either way; none in a text without one."""
    n = (F.col("rec_no") % 100 + 9).cast("string")
    big = F.concat(F.lit('{"bbox_2d": [0, 0, '), n, F.lit(', 20], "label": "hand"}'))
    small = F.lit('{"bbox": [0, 0, 1, 1], "label": "small"}')
    text = F.when(F.col("rec_no") % 4 == 0, "no box [here").when(F.col("rec_no") % 4 == 3, F.concat(F.lit("x ["), small, F.lit(', {"label": "none"}] y'))).otherwise(
        F.concat(F.lit("```json\n["), small, F.lit(","), big, F.lit("]\n```")))
    box = Q.largest_box(text)
    return table(spark, sf_dir, "fp_metadata").select("rec_no", box["label"].alias("label"), F.get(box["box"], 2).alias("x2"))


# --- tracks ------------------------------------------------------------------

_ANSWERS = "CASE o_orderkey % 4 WHEN 0 THEN 'Yes <SEP> No' WHEN 1 THEN 'well no, yes and yes' WHEN 2 THEN 'only yes' ELSE 'nothing' END"


@query(f"""
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'NO' WHEN 2 THEN 'YES' END AS a, CASE o_orderkey % 4 WHEN 0 THEN 'No' WHEN 1 THEN 'YES' END AS b FROM (SELECT o_orderkey, {_ANSWERS} AS t FROM orders)
""")
def answers_split(spark, sf_dir):
    m = F.col("o_orderkey") % 4
    text = F.when(m == 0, "Yes <SEP> No").when(m == 1, "well no, yes and yes").when(m == 2, "only yes").otherwise("nothing")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.two_answers(text).alias("x")).select("o_orderkey", "x.*")


@query("SELECT event_id, l IN ('reach', 'reposition', 'transport') AS motion, l IN ('transport', 'stabilize') AS grasp FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'reach' WHEN 'purchase' THEN 'transport' WHEN 'error' THEN 'stabilize' WHEN 'view' THEN 'reposition' ELSE 'idle' END AS l FROM events)")
def label_flags(spark, sf_dir):
    e = F.col("event_type")
    label = F.when(e == "click", "Reach ").when(e == "purchase", "transport").when(e == "error", "STABILIZE").when(e == "view", "reposition").otherwise("idle")
    return table(spark, sf_dir, "events").select("event_id", R.label_flags(label).alias("x")).select("event_id", "x.*")


@query(f"""
    WITH s AS (SELECT *, CASE event_type WHEN 'click' THEN 'reach' WHEN 'purchase' THEN 'transport' WHEN 'error' THEN 'stabilize' ELSE 'idle' END AS l FROM {_SEGS} WHERE t1 > t0),
    w AS (SELECT DISTINCT user_id, t0 // 86400000 AS window_id FROM s UNION SELECT DISTINCT user_id, -1 FROM s)
    SELECT w.user_id, window_id, CASE WHEN count(l) = count(*) FILTER (WHERE l = 'idle') THEN 'IDLE/STABILIZE' WHEN count(l) = count(*) FILTER (WHERE l IN ('reach', 'transport')) THEN 'ACTIVE' ELSE 'EITHER' END AS tag
    FROM w LEFT JOIN s ON s.user_id = w.user_id AND t0 < (window_id + 1) * 86400000 AND window_id * 86400000 < t1 GROUP BY w.user_id, window_id
""")
def window_tags(spark, sf_dir):
    s = _segs(spark, sf_dir)
    e = F.col("event_type")
    s = s.withColumn("label", F.when(e == "click", "reach").when(e == "purchase", "transport").when(e == "error", "stabilize").otherwise("idle"))
    ids = s.select("user_id", F.floor(F.col("t0") / 86_400_000).cast("bigint").alias("window_id")).unionByName(s.select("user_id", F.lit(-1).cast("bigint").alias("window_id"))).distinct()
    w = ids.select("user_id", "window_id", (F.col("window_id") * 86_400_000).alias("t0"), ((F.col("window_id") + 1) * 86_400_000).alias("t1"))
    return R.activity_tags(w, s, ["user_id"])


@query("""
    SELECT qid, CASE WHEN qid % 2 = 0 THEN 'reach@0.000;transport@1.000;stabilize@2.000;reposition@3.000;reposition@4.000' ELSE 'reach@0.000;idle@2.000;transport@4.000;transport@6.000' END AS track FROM fm_item_questions
""")
def output_to_track(spark, sf_dir):
    """Pairs of answers and free text, each by its own reading."""
    seg = lambda t, a, b: F.struct(F.lit(t).alias("text"), F.lit(float(a)).alias("t0"), F.lit(float(b)).alias("t1"))
    pairs = F.array(seg("Yes <SEP> No", 0, 1), seg("Yes <SEP> Yes", 1, 2), seg("no <SEP> yes", 2, 3), seg("Yes <SEP> No", 3, 4))
    text = F.array(seg("First REACH, then idle.", 0, 4), seg("transport", 4, 6))
    segs = F.when(F.col("qid") % 2 == 0, pairs).otherwise(text)
    return table(spark, sf_dir, "fm_item_questions").select("qid", R.results_of_output(segs, list(R.LABELS)).alias("track"))


@query(f"""
    WITH e AS (SELECT *, CASE event_type WHEN 'click' THEN 'reach' WHEN 'purchase' THEN 'transport' WHEN 'error' THEN 'stabilize' WHEN 'view' THEN 'reposition' ELSE 'idle' END AS l FROM {EV}),
    f AS (SELECT *, l IN ('reach', 'reposition', 'transport') AS m, l IN ('transport', 'stabilize') AS c FROM e),
    a AS (SELECT *, max(c::INT) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 7200000 FOLLOWING) AS ahead FROM f)
    SELECT user_id, event_id, CASE WHEN m AND c THEN 'transport' WHEN m THEN CASE WHEN ahead = 1 THEN 'reach' ELSE 'reposition' END WHEN c THEN 'stabilize' ELSE 'idle' END AS label FROM a
""")
def baseline_omniscient(spark, sf_dir):
    e = F.col("event_type")
    label = F.when(e == "click", "reach").when(e == "purchase", "transport").when(e == "error", "stabilize").when(e == "view", "reposition").otherwise("idle")
    rows = events(spark, sf_dir).withColumn("label", label)
    return R.omniscient_labels(rows, ["user_id"], "t", "label", 7_200_000).select("user_id", "event_id", "label")


@query("SELECT rec_no, 'transport@0.000;transport@' || printf('%.3f', duration_s) AS track FROM fp_metadata WHERE duration_s IS NOT NULL")
def baseline_constant(spark, sf_dir):
    return table(spark, sf_dir, "fp_metadata").where("duration_s IS NOT NULL").select("rec_no", R.constant_track("transport", F.lit(0.0), F.col("duration_s")).alias("track"))


@query(f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, CASE event_type WHEN 'error' THEN 'abstain' WHEN 'signup' THEN 'fast' WHEN 'view' THEN 'still' ELSE '' END AS s, event_id % 4 = 0 AS rests, event_id % 3 = 0 AS picks, event_id % 5 = 0 AS drops FROM {EV}),
    f AS (SELECT user_id, event_id, i, s, rests, CASE s WHEN 'abstain' THEN false WHEN 'fast' THEN false ELSE picks END AS h FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_id, e.i, e.s, e.rests, CASE WHEN e.s = 'abstain' THEN false WHEN e.s = 'fast' THEN f.h WHEN f.h THEN NOT e.drops ELSE e.picks END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, event_id, CASE WHEN s = 'abstain' OR (s <> 'fast' AND rests) THEN 'idle' WHEN NOT h THEN 'reach' WHEN s = 'still' THEN 'stabilize' ELSE 'transport' END AS label FROM f
""")
def pose_states(spark, sf_dir):
    e, n = F.col("event_type"), F.col("event_id")
    rows = events(spark, sf_dir).withColumn("status", F.when(e == "error", "abstain").when(e == "signup", "fast").when(e == "view", "still"))
    return R.pose_states(rows, ["user_id"], ["t", "event_id"], "status", n % 4 == 0, n % 3 == 0, n % 5 == 0).select("user_id", "event_id", "label")


@query(f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS p, event_type <> 'purchase' AS h, event_type IN ('click', 'view') AS s, event_type FROM {EV}),
    r AS (SELECT *, p - row_number() OVER (PARTITION BY user_id, h ORDER BY p) AS hg, p - row_number() OVER (PARTITION BY user_id, s ORDER BY p) AS sg FROM e),
    hold AS (SELECT user_id, hg, max(p) + 1 AS fin FROM r WHERE h GROUP BY user_id, hg),
    st AS (SELECT user_id, hg, sg, min(p) AS a, max(p) + 1 AS b FROM r WHERE h AND s GROUP BY user_id, hg, sg),
    x AS (SELECT st.*, fin, b - a >= 4 AS long, max(CASE WHEN b - a >= 4 THEN b END) OVER (PARTITION BY st.user_id, st.hg ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM st JOIN hold ON hold.user_id = st.user_id AND hold.hg = st.hg),
    y AS (SELECT user_id, CASE WHEN long THEN a WHEN fin - 2 - seen < 2 THEN least(seen, fin - 2) ELSE fin - 2 END AS f, CASE WHEN long THEN b ELSE fin END AS u FROM x WHERE long OR fin - b <= 6)
    SELECT e.user_id, e.event_id, CASE WHEN EXISTS (SELECT 1 FROM y WHERE y.user_id = e.user_id AND e.p >= y.f AND e.p < y.u) THEN 'stabilize' ELSE event_type END AS label FROM e
""")
def hold_stabilize(spark, sf_dir):
    e = F.col("event_type")
    rows = events(spark, sf_dir).withColumn("label", e).withColumn("h", e != "purchase").withColumn("s", e.isin("click", "view"))
    return K.hold_stabilize(rows, "user_id", ["t", "event_id"], "label", "h", "s", 2).select("user_id", "event_id", "label")


# --- names -------------------------------------------------------------------


@query("SELECT run_no, coalesce(model_name, '') AS name, split_part(coalesce(task, ''), ',none', 1) AS metric FROM (SELECT run_no, any_value(model_name) AS model_name, 'acc,none' AS task FROM run_log GROUP BY run_no)")
def name_model(spark, sf_dir):
    """The pretrained model, not the plain path before it; metrics without the empty filter."""
    args = F.concat(F.lit("path=zzz,pretrained="), F.coalesce("model_name", F.lit("")), F.lit(",n=3"))
    return log_rows(spark, sf_dir, "run_log", "model_name").select("run_no", N.model_name(args).alias("name"), N.without_none(F.lit("acc,none")).alias("metric"))


@query("SELECT qid, CASE qid % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'list' ELSE 'str' END AS kind, CASE WHEN qid % 3 = 0 THEN qid::BIGINT END AS number, CASE WHEN qid % 3 = 1 THEN 'a|b, c|' || qid END AS items FROM fm_item_questions")
def name_literal(spark, sf_dir):
    m, q = F.col("qid") % 3, F.col("qid").cast("string")
    text = F.when(m == 0, q).when(m == 1, F.concat(F.lit("['a', \"b, c\", "), q, F.lit("]"))).otherwise(F.concat(F.lit("x"), q))
    return table(spark, sf_dir, "fm_item_questions").select("qid", N.literal(text).alias("x")).select("qid", "x.kind", "x.number", F.array_join("x.items", "|").alias("items"))


@query("""
    SELECT rec_no, CASE WHEN rec_no % 2 = 0 THEN CASE WHEN stroke THEN 'A' ELSE 'H' END END AS laterality, CASE rec_no % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'S' END AS view FROM fp_metadata WHERE stroke IS NOT NULL
""")
def name_sides(spark, sf_dir):
    n = F.col("rec_no")
    rows = table(spark, sf_dir, "fp_metadata").where("stroke IS NOT NULL")
    affected = F.when(F.col("stroke"), "Left").otherwise("Right")
    return rows.select("rec_no", N.watched_side(F.when(n % 2 == 0, "L"), affected).alias("laterality"), N.video_view(F.when(n % 3 == 0, "Front").when(n % 3 == 1, "Left")).alias("view"))


@query("SELECT DISTINCT run_no, strftime(written_at AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo', '%Y%m%d_%H%M%S') AS stamp FROM run_log")
def name_local_stamp(spark, sf_dir):
    return log_rows(spark, sf_dir, "run_log", "written_at").select("run_no", N.local_stamp(F.col("written_at"), "Asia/Tokyo").alias("stamp"))


@query("SELECT n_nationkey, string_agg(base || '=' || name, ';' ORDER BY i) AS items FROM (SELECT n_nationkey, unnest([1, 2, 3]) AS i, unnest(['a', 'b', n_name]) AS base, unnest(['x y', 'b', 'z']) AS name FROM nation) GROUP BY n_nationkey")
def name_list(spark, sf_dir):
    text = F.concat(F.lit("a\told\r\nb / "), "n_name", F.lit("|z\n\n,none\na, x,y"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(N.name_list(text), lambda x: F.concat(x["base"], F.lit("="), x["name"])), ";").alias("items"))
