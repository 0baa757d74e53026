"""Queries on files, prompts, geometry, audits, batches and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracksift.functions import geometry as G
from tracksift.functions import text as X
from tracksift.operators import grouped as GR
from tracksift.operators import sampling as P
from tracksift.operators import sequences as S
from tracksift.operators import state as K
from tracksift.operators import windows as W
from tracksift.plans.catalog import half_up, query, sql_draw
from tracksift.plans.catalog_sequences import EV, events
from tracksift.session import shared_dir
from tracksift.session import materialize
from tracksift.sources import logs as L
from tracksift.sources.tables import log_rows, table


def _path(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


# --- files ------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def io_csv(spark, sf_dir):
    """Written as semicolon-separated text and read back with a declared schema."""
    path = _path(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("sep", ";").option("header", True).csv(path)
    return L.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double", sep=";")


@query("SELECT doc_id, target, CAST(len(filtered_resps) AS BIGINT) AS n, CAST(cardinality(arguments) AS BIGINT) AS n_args, prompt_hash FROM (SELECT DISTINCT ON (sample_no) * FROM sample_log)")
def io_jsonl(spark, sf_dir):
    """All sample logs as JSON lines, with a broken line put among them and skipped."""
    path = _path(spark, "jsonl")
    rows = log_rows(spark, sf_dir, "sample_log", "doc_id", "target", "filtered_resps", "arguments", "prompt_hash")
    lines = rows.select(F.to_json(F.struct("doc_id", "target", "filtered_resps", "arguments", "prompt_hash")).alias("value"))
    lines.unionByName(spark.range(1).select(F.lit('{"doc_id": 1, "target').alias("value"))).write.text(path)
    read = L.read_samples(spark, path).where("_corrupt_record IS NULL")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint")
    return read.select("doc_id", "target", size("filtered_resps").alias("n"), size("arguments").alias("n_args"), "prompt_hash")


@query()
def io_jsonl_whole(spark, sf_dir):
    """The round trip of all samples, nested and NULL fields included."""
    path = _path(spark, "jsonl")
    cols = ["doc_id", "target", "arguments", "resps", "filtered_resps"]
    lines = log_rows(spark, sf_dir, "sample_log", *cols).select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))
    lines.unionByName(spark.range(1).select(F.lit('{"doc_id": 1, "target').alias("value"))).write.text(path)
    read = materialize(L.read_samples(spark, path).select(*cols, "_corrupt_record"), "samples")  # Spark counts no rows by that column alone
    return read.where("_corrupt_record IS NULL").drop("_corrupt_record")


@query("SELECT r_regionkey, r_name FROM region")
def io_records(spark, sf_dir):
    """One file of concatenated objects over several lines, between other text."""
    path = _path(spark, "records")
    one = F.concat(F.lit("log:\n{\n\"r_regionkey\": "), F.col("r_regionkey").cast("string"), F.lit(",\n\"r_name\": \""), "r_name", F.lit("\"}\n{broken"))
    table(spark, sf_dir, "region").coalesce(1).select(one.alias("value")).write.text(path)
    return L.read_records(spark, path, "r_regionkey int, r_name string").select("r_regionkey", "r_name")


# --- prompts, nested responses, names --------------------------------------


@query("""
    SELECT sample_no, CAST(count(*) AS BIGINT) AS n_segments, round(sum(TRY_CAST(s[3] AS DOUBLE) - TRY_CAST(s[2] AS DOUBLE)), 4) AS seconds
    FROM (SELECT sample_no, unnest(b) AS s FROM (SELECT sample_no, unnest(a) AS b FROM (SELECT sample_no, unnest(resps) AS a FROM (SELECT DISTINCT ON (sample_no) sample_no, resps FROM sample_log)))) GROUP BY sample_no
""")
def explode_responses(spark, sf_dir):
    rows = log_rows(spark, sf_dir, "sample_log", "resps").where("resps IS NOT NULL")
    segs = rows.select("sample_no", F.explode(F.flatten(F.flatten("resps"))).alias("s"))
    at = lambda i: F.try_element_at("s", F.lit(i)).try_cast("double")
    return segs.groupBy("sample_no").agg(F.count("*").alias("n_segments"), F.round(F.sum(at(3) - at(2)), 4).alias("seconds"))


@query(f"""
    WITH p AS (SELECT qid AS shot, question_type || ' -> ' || sampling AS text, row_number() OVER (ORDER BY qid) AS spot, count(*) OVER () AS n FROM fm_item_questions),
    d AS (SELECT qid, fm_video, j, floor(j * n / 3.0)::BIGINT AS low, floor((j + 1) * n / 3.0)::BIGINT AS high FROM fm_item_questions, range(3) t(j), (SELECT max(n) AS n FROM p)),
    a AS (SELECT qid, fm_video, j, 1 + low + {sql_draw(3, "at", "qid", "j")} % (high - low) AS spot FROM d),
    x AS (SELECT qid, fm_video, text, row_number() OVER (PARTITION BY qid ORDER BY {sql_draw(3, "order", "qid", "j")}, j) AS r FROM a JOIN p USING (spot) WHERE shot <> qid)
    SELECT qid, 'Answer.' || chr(10) || string_agg(text, chr(10) ORDER BY r) || chr(10) || any_value(fm_video) AS prompt FROM x WHERE r <= 2 GROUP BY qid
""")
def fewshot_prompt(spark, sf_dir):
    """Description, two examples that aren't the question itself, the question."""
    q = table(spark, sf_dir, "fm_item_questions")
    shots = P.fewshot(q, "qid", q.select(F.col("qid").alias("shot")), "shot", 2, 3)
    text = q.select(F.col("qid").alias("shot"), F.concat("question_type", F.lit(" -> "), "sampling").alias("example"))
    parts = shots.join(text, "shot").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("shot_no", "example"))).alias("x"))
    body = F.array_join(F.transform("x", lambda s: s["example"]), "\n")
    return q.select("qid", "fm_video").join(parts, "qid").select("qid", F.concat(F.lit("Answer.\n"), body, F.lit("\n"), "fm_video").alias("prompt"))


@query(r"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[Ll]eft\b', 'top', 'g'), '\b[Rr]ight\b', 'bottom', 'g'), ' ([.,;:!?)])', '\1', 'g'), ' +', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL
""")
def text_rewrite(spark, sf_dir):
    """Sides renamed in either case, and the blanks of a tokenizer taken back."""
    t = F.regexp_replace(F.regexp_replace("text", r"\b[Ll]eft\b", "top"), r"\b[Rr]ight\b", "bottom")
    t = F.regexp_replace(F.regexp_replace(t, r" ([.,;:!?)])", "$1"), " +", " ")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", t.alias("t"))


@query("SELECT DISTINCT task FROM sample_log WHERE task GLOB 'strokerehab_*_1' OR task GLOB 'strokerehab_ia?_lower'")
def wildcard_tasks(spark, sf_dir):
    rx = "|".join(X.glob_like(p) for p in ("strokerehab_*_1", "strokerehab_ia?_lower"))
    return table(spark, sf_dir, "sample_log").select("task").where(F.col("task").rlike(rx)).distinct()


@query("SELECT a.p_partkey, CASE WHEN a.p_name = b.p_name THEN 2 WHEN split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) THEN 1 ELSE 0 END AS n FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def common_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.split("p_name", " ").alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", X.common_prefix_length(F.split("p_name", " "), F.col("other")).alias("n"))


# --- sequences --------------------------------------------------------------


@query(r"""
    WITH x AS (SELECT doc_id, regexp_extract_all(lower(text), '(reach|idle|transport|stabilize|reposition)') AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS label, round(10 + 20.0 * (generate_subscripts(l, 1) - 1) / len(l), 6) AS at FROM x
""")
def seq_free_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.lit(10.0).alias("t0"), F.lit(30.0).alias("t1"))
    out = S.free_text_labels(rows, ["doc_id"], "text", "t0", "t1", ["reach", "idle", "transport", "stabilize", "reposition"])
    return out.select("doc_id", "pos", "label", F.round("at", 6).alias("at"))


@query(f"""
    WITH m AS (SELECT user_id, t, event_id, CASE event_type WHEN 'click' THEN 's' WHEN 'view' THEN 'e' ELSE 't' END AS k FROM {EV}),
    r AS (SELECT *, coalesce(sum(CASE k WHEN 's' THEN 1 WHEN 'e' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM m)
    SELECT user_id, sum((k = 's')::INT)::BIGINT AS n_clips, sum((k = 's' AND o > 0)::INT)::BIGINT AS overlapping, greatest(sum(CASE k WHEN 's' THEN 1 WHEN 'e' THEN -1 ELSE 0 END), 0)::BIGINT AS left_open, sum((k = 'e' AND o <= 0)::INT)::BIGINT AS stray_ends FROM r GROUP BY user_id
""")
def clip_audit(spark, sf_dir):
    e = F.col("event_type")
    marks = events(spark, sf_dir).withColumn("k", F.when(e == "click", "s").when(e == "view", "e").otherwise("t"))
    return S.clip_audit(marks, ["user_id"], ["t", "event_id"], "k")


@query(f"""
    SELECT user_id, string_agg(CASE event_type WHEN 'click' THEN 's' ELSE 'e' END || ':' || printf('%.3f', (t - 1704067200000) / 1000.0), ',' ORDER BY t, CASE event_type WHEN 'click' THEN 1 ELSE 0 END, event_id) AS times FROM {EV} WHERE event_type IN ('click', 'view') GROUP BY user_id
""")
def annotation_export(spark, sf_dir):
    e = F.col("event_type")
    marks = events(spark, sf_dir).select("user_id", F.when(e == "click", "s").when(e == "view", "e").otherwise("t").alias("kind"), ((F.col("t") - 1704067200000) / 1000.0).alias("at"))
    return L.annotation_rows(marks, ["user_id"])


@query()
def seq_simulate(spark, sf_dir):
    shares = S.transitions(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type")
    return S.simulate(shares, "view", 20, 50, 7)


@query(f"SELECT user_id, event_type AS label, count(*) AS n, count(*) FILTER (WHERE t >= 1705276800000) - count(*) FILTER (WHERE t < 1705276800000) AS off FROM {EV} GROUP BY user_id, event_type")
def class_count_errors(spark, sf_dir):
    """Per label the difference of two halves' counts."""
    late = F.col("t") >= 1705276800000
    return events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("label")).agg(F.count("*").alias("n"), (F.count_if(late) - F.count_if(~late)).alias("off"))


# --- geometry ---------------------------------------------------------------


@query("""
    SELECT rec_no, greatest(least(duration_s * 7 - 112.0, width - 224), 0)::DOUBLE AS x1, least(greatest(least(duration_s * 7 - 112.0, width - 224), 0) + 224, width)::DOUBLE AS x2,
      round(greatest(least(100.0 + (duration_s - 100.0) * 1.5, height), 0)::DOUBLE, 6) AS hand FROM fp_metadata WHERE duration_s IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL
""")
def crop_boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "fp_metadata").where("duration_s IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
    box = G.crop_box(F.col("duration_s") * 7, F.col("duration_s") * 5, F.col("width"), F.col("height"))
    hand = G.extended_point(F.lit(100.0), F.col("duration_s"), 0.5, F.col("height"))
    return rows.select("rec_no", box["x1"].alias("x1"), box["x2"].alias("x2"), F.round(hand, 6).alias("hand"))


@query("""
    WITH m AS (SELECT rec_no, CAST(floor(duration_s * fps) AS BIGINT) AS n, greatest(floor(fps / 2.0), 1)::BIGINT AS s FROM fp_metadata WHERE duration_s IS NOT NULL AND fps IS NOT NULL)
    SELECT rec_no, CAST(CASE WHEN (n - 1) // s + 2 > 64 THEN 64 ELSE len(list_distinct(list_append(range(0, n, s), n - 1))) END AS INTEGER) AS k FROM m WHERE n > 0
""")
def win_capped(spark, sf_dir):
    rows = table(spark, sf_dir, "fp_metadata").where("duration_s IS NOT NULL AND fps IS NOT NULL").select("rec_no", F.floor(F.col("duration_s") * F.col("fps")).alias("n"), "fps").where("n > 0")
    return rows.select("rec_no", F.size(G.capped_frames(F.col("n"), F.col("fps"), 2.0, 64)).alias("k"))


@query("""
    WITH c AS (SELECT label, avg(embedding[1]::DOUBLE) AS a, avg(embedding[2]::DOUBLE) AS b FROM embeddings GROUP BY label)
    SELECT vec_id, arg_min(c.label, pow(embedding[1]::DOUBLE - a, 2) + pow(embedding[2]::DOUBLE - b, 2)) AS nearest FROM embeddings, c GROUP BY vec_id
""")
def join_nearest(spark, sf_dir):
    """The nearest of the labels' centres, which are as few as labels and ride along as one array."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    centres = rows.groupBy("label").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).agg(F.collect_list(F.struct(F.col("label").alias("id"), "a", "b")).alias("c"))
    return rows.crossJoin(F.broadcast(centres)).select("vec_id", G.nearest([F.col("a"), F.col("b")], F.col("c"), ["a", "b"]).alias("nearest"))


@query("""
    WITH p AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, abs(embedding[3]::DOUBLE) AS c FROM embeddings)
    SELECT label, CASE WHEN count(*) >= 4 AND arg_min(c, vec_id) >= 0.01 AND arg_max(c, vec_id) >= 0.01 THEN greatest(abs(arg_max(x, vec_id) - arg_min(x, vec_id)), abs(arg_max(y, vec_id) - arg_min(y, vec_id))) > 0.001 * (count(*) - 1) END AS moved FROM p GROUP BY label
""")
def pose_moved(spark, sf_dir):
    v = F.col("embedding")
    points = table(spark, sf_dir, "embeddings").select("label", "vec_id", v[0].cast("double").alias("x"), v[1].cast("double").alias("y"), F.abs(v[2].cast("double")).alias("conf"))
    return W.moved(points, ["label"], "vec_id", 0.001, 4, 0.01)


# --- audits, batches, reports ----------------------------------------------


@query("""
    WITH g AS (SELECT n_nationkey, seg FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer)), c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY ALL)
    SELECT n_nationkey, CAST(sum((n IS NULL)::INT) AS BIGINT) AS missing, CAST(coalesce(sum((n > 1)::INT), 0) AS BIGINT) AS repeated FROM g LEFT JOIN c ON n_nationkey = c_nationkey AND seg = c_mktsegment GROUP BY n_nationkey
""")
def completeness_audit(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    out = GR.audit(table(spark, sf_dir, "nation").select("n_nationkey"), c.select("seg"), c.where("c_acctbal > 8000"), ["n_nationkey"], ["seg"])
    return out.select("n_nationkey", "missing", "repeated")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) = 4")
def complete_groups(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n = 4")


@query("""
    SELECT patient, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right, CASE WHEN sum(r) > sum(l) THEN 'right' ELSE 'left' END AS arm FROM (
      SELECT patient, (lower(MarkerNames) LIKE 'l%')::INT AS l, (lower(MarkerNames) LIKE 'r%')::INT AS r FROM (SELECT DISTINCT ON (marker_id) * FROM label_track) WHERE patient IS NOT NULL AND MarkerNames IS NOT NULL) GROUP BY patient
""")
def majority_arm(spark, sf_dir):
    rows = log_rows(spark, sf_dir, "label_track", "patient", "MarkerNames").where("patient IS NOT NULL AND MarkerNames IS NOT NULL")
    low = F.lower("MarkerNames")
    return GR.majority_side(rows, ["patient"], low.startswith("l"), low.startswith("r"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 6) AS share FROM lineitem GROUP BY ALL")
def regime_share(spark, sf_dir):
    sums = GR.share_of_all(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity"))
    return sums.select("l_returnflag", "l_linestatus", half_up(F.col("share")).alias("share"))


@query("SELECT o_orderstatus, CASE WHEN count(DISTINCT o_totalprice > 100000) = 1 THEN bool_and(o_totalprice > 100000) END AS agreed, count(*) AS original, least(count(*), 1000) AS effective FROM orders GROUP BY o_orderstatus")
def flag_consensus(spark, sf_dir):
    flag = F.col("o_totalprice") > 100000
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(GR.consensus(flag).alias("agreed"), *GR.sample_sizes(1000))


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) - 1) // 64 AS BIGINT) AS batch FROM orders")
def group_batches(spark, sf_dir):
    """Batches of 64 within a group, longest first."""
    return GR.batched(table(spark, sf_dir, "orders"), ["o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 64).select("o_orderkey", "batch")


@query("""
    WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL AND text <> '')
    SELECT doc_id, CAST(i AS BIGINT) AS win, array_to_string(w[i * 40 + 1 : i * 40 + 50], ' ') AS part FROM (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil((len(w) - 50) / 40.0) AS BIGINT), 0) + 1)) AS i FROM d)
""")
def token_windows(spark, sf_dir):
    """Windows of 50 tokens that share 10 with the one before."""
    d = table(spark, sf_dir, "documents").where("text <> ''")
    at = d.select("doc_id", F.posexplode(GR.rolling_windows(F.split("text", " "), 50, 10)).alias("win", "part"))
    return at.select("doc_id", F.col("win").cast("bigint").alias("win"), F.array_join("part", " ").alias("part"))


@query("SELECT l_returnflag, l_linestatus, CASE r WHEN 1 THEN '\\textbf{' || c || '}' WHEN 2 THEN '\\underline{' || c || '}' ELSE c END AS cell FROM (SELECT l_returnflag, l_linestatus, printf('%.2f $\\pm$ %.2f', v, s) AS c, rank() OVER (PARTITION BY l_linestatus ORDER BY v DESC) AS r FROM (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS v, stddev_samp(l_extendedprice) / sqrt(count(*)) AS s FROM lineitem GROUP BY ALL))")
def latex_table(spark, sf_dir):
    v = "l_extendedprice"
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg(v).alias("v"), (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("s"))
    return L.latex_cells(rows, ["l_linestatus"], "v", "s").select("l_returnflag", "l_linestatus", "cell")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN -1.0 ELSE c_acctbal END AS bal FROM customer")
def overrides(spark, sf_dir):
    """Values of a small table put over those of a large one."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"))
    return GR.overridden(c, "c_custkey", c.where("c_custkey % 10 = 0").select("c_custkey", F.lit(-1.0).alias("bal")), "bal")


@query("SELECT gt, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (), 6) AS share, n = max(n) OVER () AS majority FROM (SELECT activity AS gt, count(*) AS n FROM fp_metadata WHERE activity IS NOT NULL GROUP BY activity)")
def majority_baseline(spark, sf_dir):
    rows = GR.majority_class(table(spark, sf_dir, "fp_metadata").withColumnRenamed("activity", "gt"), "gt")
    return rows.select("gt", "n", half_up(F.col("share")).alias("share"), "majority")