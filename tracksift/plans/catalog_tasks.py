"""Queries on whole evaluations, logs, corpus scores, templates and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksift.operators import corpus_scores
from tracksift.plans import task as T
from tracksift.plans.catalog import half_up, query, sql_mean
from tracksift.plans.catalog_sequences import EV
from tracksift.sources import logs as L
from tracksift.sources.tables import log_rows, table
from tracksift.streaming import folds


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "fm_item_questions").select(F.col("qid").cast("bigint").alias("doc_id"), "question_type", "sampling", "fm_video")


T.register(T.TASKS, "question_kind")(T.Task(
    "question_kind", _docs, "{{ fm_video | regex_replace('_', ' ') }}: {{ sampling }}", "{{ question_type }}",
    {"first": [("take_first", {})], "vote": [("lowercase", {}), ("majority_vote", {})]}, (("exact_match", "mean"), ("contains", "mean")), repeats=1))
T.register(T.TASKS, "question_sampling")(T.Task(
    "question_sampling", _docs, "{{ question_type }}", "{{ sampling }}", metrics=(("exact_match", "perplexity"),)))
T.register(T.GROUPS, "questions")(["question_*"])


@T.register(T.RESPONSE_SOURCES, "echo_binary")
def _binary(asked):
    """A fixed answer, then two by the document's parity."""
    odd = F.col("doc_id") % 2 == 1
    return asked.withColumn("resps", F.array(F.lit("binary"), F.when(odd, "RATE").otherwise("Uniform"), F.when(odd, "rate").otherwise("uniform")))


@query(f"""
    WITH q AS (SELECT qid, question_type AS t, sampling AS s, CASE WHEN qid % 2 = 1 THEN 'rate' ELSE 'uniform' END AS v FROM fm_item_questions),
    x AS (SELECT 'question_kind' AS task, 'first' AS filter, 'exact_match' AS metric, (t = 'binary')::INT::DOUBLE AS v FROM q UNION ALL SELECT 'question_kind', 'first', 'contains', contains('binary', t)::INT::DOUBLE FROM q
      UNION ALL SELECT 'question_kind', 'vote', 'exact_match', (t = v)::INT::DOUBLE FROM q UNION ALL SELECT 'question_kind', 'vote', 'contains', contains(v, t)::INT::DOUBLE FROM q)
    SELECT task, filter, metric, round({sql_mean('v')}, 6) AS value, round(stddev_samp(v) / sqrt(count(*)), 6) AS stderr, count(*) AS n FROM x GROUP BY task, filter, metric
    UNION ALL SELECT 'question_sampling', 'none', 'exact_match', round(exp(-avg((s = 'binary')::INT)), 6), NULL, count(*) FROM q
""")
def task_results(spark, sf_dir):
    """Without resampling, which its SQL has no number for; see ``task_results_bootstrap``."""
    rows = T.evaluate(["questions"], spark, sf_dir, "echo_binary", rounds=0)
    return rows.select("task", "filter", "metric", half_up(F.col("value")).alias("value"), F.round("stderr", 6).alias("stderr"), "n")


@query()
def task_results_bootstrap(spark, sf_dir):
    """The same results with all standard errors, over 100,000 rounds."""
    return T.evaluate(["questions"], spark, sf_dir, "echo_binary")


@query("SELECT CAST(qid AS BIGINT) AS doc_id, replace(fm_video, '_', ' ') || ': ' || sampling AS prompt, question_type AS target, sha256(replace(fm_video, '_', ' ') || ': ' || sampling) AS prompt_hash FROM fm_item_questions")
def task_requests(spark, sf_dir):
    return T.requests(T.TASKS["question_kind"], spark, sf_dir).select("doc_id", "prompt", "target", "prompt_hash")


@query("SELECT (qid % 3 = 0) AS cached, count(*) AS n FROM fm_item_questions GROUP BY 1")
def task_cache(spark, sf_dir):
    """Requests answered from a cache, and the rest by an anti join."""
    asked = T.requests(T.TASKS["question_kind"], spark, sf_dir).withColumn("prompt_hash", F.sha2(F.concat("prompt_hash", F.col("doc_id").cast("string")), 256))
    cache = asked.where("doc_id % 3 = 0").select("prompt_hash", F.array(F.lit("x")).alias("resps"))
    have, miss = T.cached_responses(asked, cache)
    return have.agg(F.count("*").alias("n")).select(F.lit(True).alias("cached"), "n").unionByName(miss.agg(F.count("*").alias("n")).select(F.lit(False).alias("cached"), "n"))


@query("""
    WITH s AS (SELECT DISTINCT sample_no, task, doc_id, run_no, accuracy FROM sample_log),
    r AS (SELECT *, row_number() OVER (PARTITION BY task, doc_id ORDER BY run_no DESC, sample_no DESC) AS k FROM s)
    SELECT task, doc_id, run_no, accuracy FROM r WHERE k = 1
""")
def log_replay(spark, sf_dir):
    """Of each (task, doc_id) the answer of the newest run."""
    rows = log_rows(spark, sf_dir, "sample_log", "task", "doc_id", "run_no", "accuracy")
    docs = rows.select("task", "doc_id").distinct()
    return L.replayed(docs, rows.withColumn("o", F.struct("run_no", "sample_no")), ["task", "doc_id"], "o", ["run_no", "accuracy"])


@query(r"""
    SELECT series AS folder, max(file_name) AS newest FROM (SELECT DISTINCT series, file_name FROM run_log) GROUP BY series
""")
def log_newest(spark, sf_dir):
    files = log_rows(spark, sf_dir, "run_log", "series", "file_name").select(F.concat_ws("/", "series", "file_name").alias("path"))
    return L.newest_per_folder(files).select("folder", F.element_at(F.split("path", "/"), -1).alias("newest"))


@query("SELECT rec_no FROM fp_metadata WHERE len(string_split(path_v, '/')) = (SELECT arg_max(d, n * 1000 - d) FROM (SELECT len(string_split(path_v, '/')) AS d, count(*) AS n FROM fp_metadata WHERE path_v IS NOT NULL GROUP BY 1))")
def modal_path_depth(spark, sf_dir):
    return L.modal_depth(table(spark, sf_dir, "fp_metadata").where("path_v IS NOT NULL"), "path_v").select("rec_no")


@query()
def agg_corpus_scores(spark, sf_dir):
    """BLEU, chrF and TER of each task's whole answers against their targets."""
    rows = log_rows(spark, sf_dir, "sample_log", "task", "target", "filtered_resps")
    return corpus_scores.corpus_scores(rows.withColumn("answer", F.array_join("filtered_resps", "\n")), ["task"], "answer", "target")


@query(f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM {EV}),
    s AS (SELECT user_id, event_id, i, event_type IN ('click', 'purchase') AS motion FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN s.motion THEN e.event_type <> 'view' ELSE e.event_type IN ('click', 'purchase') END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
    SELECT user_id, event_id, motion FROM s
""")
def stream_state_fold(spark, sf_dir):
    """The state fold as a stream over the events' file; same rows as ``state_fold``."""
    return folds.run_to_table(folds.motion_stream(folds.stream_events(spark, f"{sf_dir}/events.parque[t]")), "motion")


@query("SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    """Daily windows of a stream over the events' file, the open ones too."""
    rows = folds.run_to_whole_table(folds.windowed_counts(folds.stream_events(spark, f"{sf_dir}/events.parque[t]")), "counts")
    return rows.select(F.date_from_unix_date(F.floor(F.col("start_ms") / 86_400_000).cast("int")).cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
    SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, i, count(*) AS n FROM i GROUP BY ALL) GROUP BY user_id, n
""")
def session_windows(spark, sf_dir):
    rows = folds.session_counts(table(spark, sf_dir, "events"))
    return rows.groupBy("user_id", "n").agg(F.count("*").alias("sessions"))
