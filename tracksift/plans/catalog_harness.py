"""Queries on task declarations, result documents, sample tables, caches and trackers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksift.operators import metrics as M
from tracksift.operators import responses as R
from tracksift.operators import scoring as Q
from tracksift.operators import state as K
from tracksift.plans import task as T
from tracksift.plans.catalog import half_up, query, sql_mean
from tracksift.plans.catalog_sequences import EV, events
from tracksift.sources import logs as L
from tracksift.sources.tables import log_rows, table

T.register(T.FUNCTIONS, "harness.kind")(lambda: F.col("question_type"))
T.register(T.FUNCTIONS, "harness.questions")(lambda spark, folder: table(spark, folder, "fm_item_questions").withColumn("doc_id", F.col("qid").cast("bigint")))
T.register(T.RESPONSE_SOURCES, "echo_upper")(lambda asked: asked.withColumn("resps", F.array(F.upper("target"))))
T.declare({"task": "declared_kind", "dataset": "!function harness.questions", "doc_to_text": "{{ fm_video }}?", "doc_to_target": "!function harness.kind", "tag": ["declared", "kinds"],
           "filter_list": [{"name": "low", "filter": [{"function": "lowercase"}, {"function": "take_first"}]}, {"name": "as_is", "filter": [{"function": "take_first"}]}],
           "metric_list": [{"metric": "exact_match", "aggregation": "mean", "ignore_case": False}]})
T.declare({"task": "declared_loose", "include": "declared_kind", "tag": "declared", "metric_list": [{"metric": "exact_match", "ignore_case": True}]})
T.declare({"task": "declared_default", "dataset": "!function harness.questions", "doc_to_text": "x", "doc_to_target": "{{ sampling }}"})


@query(f"""
    WITH q AS (SELECT question_type AS t, sampling AS s FROM fm_item_questions),
    x AS (SELECT 'declared_kind' AS task, 'low' AS filter, (lower(upper(t)) = t)::INT::DOUBLE AS v FROM q UNION ALL SELECT 'declared_kind', 'as_is', (upper(t) = t)::INT::DOUBLE FROM q
      UNION ALL SELECT 'declared_loose', 'low', 1.0 FROM q UNION ALL SELECT 'declared_loose', 'as_is', 1.0 FROM q UNION ALL SELECT 'declared_default', 'none', (upper(s) = s)::INT::DOUBLE FROM q)
    SELECT task, filter, 'exact_match' AS metric, round({sql_mean("v")}, 6) AS value, count(*) AS n FROM x GROUP BY task, filter
""")
def task_declared(spark, sf_dir):
    """Tasks from declarations: a tag's tasks, one including the other, and one with its type's metrics."""
    rows = T.evaluate(["declared", "declared_default"], spark, sf_dir, "echo_upper", rounds=0)
    return rows.select("task", "filter", "metric", half_up(F.col("value")).alias("value"), "n")


@query(f"""
    SELECT run_no % 3 AS run, task, round({sql_mean("accuracy")}, 6) AS value, CAST(count(accuracy) AS BIGINT) AS n FROM (SELECT DISTINCT sample_no, run_no, task, accuracy FROM sample_log) GROUP BY ALL
""")
def io_results_document(spark, sf_dir):
    """Results written as one JSON text per run, and read back."""
    from tracksift.session import new_path

    v = F.col("accuracy")
    rows = log_rows(spark, sf_dir, "sample_log", "run_no", "task", "accuracy").groupBy((F.col("run_no") % 3).alias("run"), "task").agg(
        M.mean(v).alias("value"), M.stderr(v).alias("stderr"), F.count(v).alias("n"))
    documents = L.results_document(rows.withColumns({"filter": F.lit("none"), "metric": F.lit("acc")}), ["run"])
    path = new_path(spark, "documents")
    L.write_documents(documents.select(F.concat(F.col("run").cast("string"), F.lit("\t"), "document").alias("document")), path)
    back = spark.read.text(path).select(F.split("value", "\t", 2).alias("x")).select(
        F.col("x")[0].cast("bigint").alias("run"), F.from_json(F.col("x")[1], "results map<string, map<string, double>>, `n-samples` map<string, bigint>").alias("d"))
    return back.select("run", F.explode("d.results").alias("task", "v"), F.col("d.n-samples").alias("n")).select(
        "run", "task", half_up(F.try_element_at("v", F.lit("acc,none"))).alias("value"), F.try_element_at("n", F.col("task")).alias("n"))


@query("SELECT l_orderkey, string_agg('[' || l_linenumber || ',' || l_suppkey || ']', ',' ORDER BY l_linenumber, l_suppkey) AS lines FROM lineitem GROUP BY l_orderkey")
def nested_as_text(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.array("l_linenumber", "l_suppkey"))).alias("lines"))
    text = rows.select("l_orderkey", L.stringified(rows, "lines").alias("lines"))
    return text.select("l_orderkey", F.array_join(F.transform("lines", lambda x: F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))), ",").alias("lines"))


@query("""
    SELECT id, data, choices, CAST(length(data) AS INTEGER) AS input_len, labels, output_type, raw_predictions, filtered_predictions FROM (
      SELECT qid AS id, fm_video AS data, NULL AS choices, question_type AS labels, 'generate_until' AS output_type, 'a' AS raw_predictions, 'b' AS filtered_predictions FROM fm_item_questions
      UNION ALL SELECT qid, fm_video, '0. x' || chr(10) || '1. y', question_type, 'multiple_choice', CASE WHEN qid % 2 = 0 THEN '1' ELSE '0' END, '0' FROM fm_item_questions
      UNION ALL SELECT qid, fm_video, NULL, 'x', 'loglikelihood', 'log probability of continuation is -1.5' || chr(10) || chr(10) || 'continuation will not be generated with greedy sampling',
        'log probability of continuation is -0.5' || chr(10) || chr(10) || 'continuation will be generated with greedy sampling' FROM fm_item_questions)
""")
def sample_tables(spark, sf_dir):
    q = table(spark, sf_dir, "fm_item_questions").select(F.col("qid").alias("doc_id"), F.col("question_type").alias("target"), "fm_video", "qid")
    asked = F.array(F.array("fm_video", F.lit("x")), F.array("fm_video", F.lit("y")))
    text = q.select("doc_id", "target", asked.alias("arguments"), F.array(F.lit("a")).alias("resps"), F.array(F.lit("b")).alias("filtered_resps"))
    choice = q.select("doc_id", "target", asked.alias("arguments"), F.array(F.lit(-1.0), F.when(F.col("qid") % 2 == 0, -0.5).otherwise(-2.0)).alias("resps"), F.array(F.lit(0.0), F.lit(-1.0)).alias("filtered_resps"))
    ll = lambda x, g: F.array(F.struct(F.lit(x).alias("ll"), F.lit(g).alias("greedy")))
    like = q.select("doc_id", "target", asked.alias("arguments"), ll(-1.5, False).alias("resps"), ll(-0.5, True).alias("filtered_resps"))
    none = F.lit(None).cast("string")
    parts = [L.sample_table(text, "generate_until").withColumn("choices", none), L.sample_table(choice, "multiple_choice"), L.sample_table(like, "loglikelihood").withColumn("choices", none)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id, doc_id % 2 = 0 AS cached, CASE WHEN doc_id % 2 = 0 THEN length(text) END AS n FROM documents WHERE text IS NOT NULL AND text <> ''")
def cache_detections(spark, sf_dir):
    """Detections known by the hash of what they were made from."""
    key = L.frame_key(F.col("doc_id"), F.lit("uint8"), F.encode("text", "UTF-8"), F.lit(0.5))
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", key.alias("key"), F.length("text").alias("_n"))
    cache = docs.where("doc_id % 2 = 0").select("key", F.col("_n").alias("n"))
    return L.with_cached(docs.select("doc_id", "key"), "key", cache, ["n"]).select("doc_id", "cached", "n")


@query("""
    WITH c AS (SELECT o_orderstatus AS g, o_orderpriority[1:1] AS p, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
    l AS (SELECT l, sum(g) AS g, sum(p) AS p, sum(h) AS h FROM (SELECT g AS l, n AS g, 0 AS p, CASE WHEN g = p THEN n ELSE 0 END AS h FROM c UNION ALL SELECT p, 0, n, 0 FROM c) GROUP BY l)
    SELECT round(coalesce((sum(h) * sum(g) - sum(g * p)) / nullif(sqrt((sum(g) ** 2 - sum(p * p)) * (sum(g) ** 2 - sum(g * g))), 0), 0), 6) AS mcc FROM l
""")
def agg_matthews_classes(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("gold"), F.substring("o_orderpriority", 1, 1).alias("pred")).agg(F.count("*").alias("n"))
    return M.matthews_multiclass(cells).select(half_up(F.col("mcc")).alias("mcc"))


@query("""
    WITH c AS (SELECT n_regionkey % 3 AS g, n_nationkey % 3 AS p, count(*) AS n FROM nation GROUP BY ALL),
    l AS (SELECT l, sum(g)::DOUBLE AS g, sum(p) AS p, sum(h) AS h FROM (SELECT g AS l, n AS g, 0 AS p, CASE WHEN g = p THEN n ELSE 0 END AS h FROM c UNION ALL SELECT p, 0, n, 0 FROM c) GROUP BY l),
    r AS (SELECT l::VARCHAR AS label, coalesce(h / nullif(p, 0), 0) AS pr, coalesce(h / nullif(g, 0), 0) AS re, coalesce(2 * h / nullif(p + g, 0), 0) AS f1, g FROM l)
    SELECT label, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f1, 6) AS f1, CAST(g AS BIGINT) AS support FROM r
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(g) AS BIGINT) FROM r
    UNION ALL SELECT 'weighted avg', round(sum(pr * g) / sum(g), 6), round(sum(re * g) / sum(g), 6), round(sum(f1 * g) / sum(g), 6), CAST(sum(g) AS BIGINT) FROM r
""")
def metric_report_averages(spark, sf_dir):
    gold, pred = (F.col("n_regionkey") % 3).cast("string"), (F.col("n_nationkey") % 3).cast("string")
    rows = M.report_averages(M.report(M.confusion(table(spark, sf_dir, "nation").select(gold.alias("g"), pred.alias("p")), "g", "p")))
    return rows.select("label", *[half_up(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS whole, round(stddev_samp(l_quantity), 6) AS sample FROM lineitem GROUP BY l_returnflag")
def agg_stddev(spark, sf_dir):
    v = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(half_up(M.stddev(v, population=True)).alias("whole"), half_up(M.stddev(v)).alias("sample"))


@query("""
    SELECT vec_id, round(CASE WHEN w <= 0 OR h <= 0 THEN 0 ELSE w * h / (a + b - w * h) END, 6) AS iou FROM (
      SELECT vec_id, least(r, 1.0) - greatest(l, 0.0) AS w, least(t, 1.0) - greatest(m, 0.0) AS h, (r - l) * (t - m) AS a, 1.0 AS b FROM (
        SELECT vec_id, least(embedding[1], embedding[3])::DOUBLE AS l, greatest(embedding[1], embedding[3])::DOUBLE AS r, least(embedding[2], embedding[4])::DOUBLE AS m, greatest(embedding[2], embedding[4])::DOUBLE AS t FROM embeddings))
""")
def metric_iou_turned(spark, sf_dir):
    """Boxes whose corners come in any order."""
    box = M.turned_box([F.get("embedding", i).cast("double") for i in range(4)])
    one = [F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)]
    return table(spark, sf_dir, "embeddings").select("vec_id", half_up(M.iou(box, one)).alias("iou"))


_OVERLAP = "greatest(least({0} + 4, {1} + 4.0) - greatest({0}, {1}), 0) / (8 - greatest(least({0} + 4, {1} + 4.0) - greatest({0}, {1}), 0))"


@query(f"""
    WITH RECURSIVE b AS (SELECT user_id, t // 3600000 AS frame, event_id AS box, value % 10.0 AS x FROM {EV} WHERE value IS NOT NULL),
    f AS (SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS i, list({{'box': box, 'x': x}}) AS l,
      max({{'i': {_OVERLAP.format("x", "2.0")}, 'nb': -box, 'x': x}}) AS top FROM b GROUP BY user_id, frame),
    r AS (SELECT user_id, frame, i, CASE WHEN top.i >= 0.3 THEN -top.nb END AS box, CASE WHEN top.i >= 0.3 THEN top.x END AS held FROM f WHERE i = 1
      UNION ALL SELECT user_id, frame, i, CASE WHEN top.i >= 0.3 THEN -top.nb WHEN held IS NOT NULL AND near.i >= 0.3 THEN -near.nb END, CASE WHEN top.i >= 0.3 THEN top.x WHEN held IS NOT NULL AND near.i >= 0.3 THEN near.x ELSE held END
        FROM (SELECT f.*, r.held, list_max(list_transform(l, lambda e: {{'i': {_OVERLAP.format("e.x", "r.held")}, 'nb': -e.box, 'x': e.x}})) AS near FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1))
    SELECT user_id, frame, 0::BIGINT AS slot, box FROM r WHERE box IS NOT NULL
""")
def slots_bound(spark, sf_dir):
    """One slot with an anchor: the box of each frame that overlaps it most."""
    rows = events(spark, sf_dir).where("value IS NOT NULL").select("user_id", F.floor(F.col("t") / 3_600_000).cast("bigint").alias("frame"), F.col("event_id").alias("box"), (F.col("value") % 10.0).alias("x1"))
    rows = rows.select("user_id", "frame", "box", "x1", F.lit(0.0).alias("y1"), (F.col("x1") + 4.0).alias("x2"), F.lit(1.0).alias("y2"))
    return K.bind_slots(rows, "user_id", [(2.0, 0.0, 6.0, 1.0)])


@query("SELECT o_orderpriority AS section, 1.0 AS pred, count(*) AS n FROM orders GROUP BY o_orderpriority")
def baseline_ones(spark, sf_dir):
    """The baseline that answers one everywhere."""
    rows = table(spark, sf_dir, "orders").withColumn("pred", F.lit(1.0))
    return rows.groupBy(F.col("o_orderpriority").alias("section"), "pred").agg(F.count("*").alias("n"))


@query("SELECT metric FROM (SELECT unnest(['acc', 'acc_norm', 'exact_match', 'perplexity']) AS metric)")
def default_metrics(spark, sf_dir):
    names = sorted({m for ms in Q.DEFAULT_METRICS.values() for m in ms})
    return spark.createDataFrame([(n,) for n in names], "metric string")


T.declare({"task": "declared_twice", "include": "declared_default", "repeats": 2, "doc_to_text": "{{ fm_video | replace('_', ' ') | upper }}?{{ question_type | capitalize }}"})
T.register(T.GROUPS, "declared_group")(["declared_kind", "declared_twice"])


@query("SELECT CAST(qid AS BIGINT) AS doc_id, CAST(r AS INTEGER) AS repeat, upper(replace(fm_video, '_', ' ')) || '?' || upper(question_type[1:1]) || lower(question_type[2:]) AS prompt FROM fm_item_questions, range(2) t(r)")
def task_repeats(spark, sf_dir):
    """Requests made twice each, from a template with piped fields."""
    return T.requests(T.TASKS["declared_twice"], spark, sf_dir).select("doc_id", "repeat", "prompt")


@query("SELECT * FROM (VALUES ('group', 'declared_group', 2, 'declared_group'), ('task', 'declared_kind', 1, '  declared_kind'), ('task', 'declared_twice', 1, '  declared_twice')) t(kind, name, members, shown)")
def task_listing(spark, sf_dir):
    return T.listing(spark, "declared_group")


@query("""
    SELECT qid, CASE qid % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'none of these' ELSE 'B' END AS choice FROM fm_item_questions
""")
def filter_simple_choice(spark, sf_dir):
    """The choice whose text stands first in the answer; the answer itself if none does."""
    q = F.col("qid") % 4
    answer = F.when(q == 0, "It's the BLUE cup, not red.").when(q == 1, "red cup").when(q == 2, "none of these!").otherwise("(blue cup) or red cup")
    question = F.lit("Which?\nA. red cup\nB. blue cup\nC. green.cup")
    lowered = F.when(q == 0, "Its the blue cup").otherwise(answer)
    return table(spark, sf_dir, "fm_item_questions").select("qid", R.simple_choice(F.array(lowered), question).alias("choice"))


@query("SELECT doc_id, regexp_replace(lower(regexp_replace(text, '[0-9]+', '', 'g')), '[[:punct:]]', '', 'g') AS kept FROM (SELECT doc_id, regexp_replace(text, '[^ -~\n]|[$+<=>^`|~]', '', 'g') AS text FROM documents WHERE text IS NOT NULL)")
def filter_ignore(spark, sf_dir):
    """Patterns, case and punctuation left out of answers (of plain characters, which both engines class alike)."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"[^ -~\n]|[$+<=>^`|~]", "").alias("t"))
    return docs.select("doc_id", F.get(R.ignore(True, True, ["[0-9]+"])(F.array("t")), 0).alias("kept"))
