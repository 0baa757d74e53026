"""Queries on writers, listings, id lists, answer sources and small text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracksift.functions import text as X
from tracksift.operators import sampling as P
from tracksift.plans import problems
from tracksift.plans.catalog import query
from tracksift.session import new_path
from tracksift.sources import logs as L
from tracksift.sources.tables import log_rows, table

_ONE = "(SELECT sample_no, any_value(filtered_resps) AS r FROM sample_log GROUP BY sample_no)"


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def io_csv_written(spark, sf_dir):
    """Written with a head and read back with commas and a declared schema."""
    path = new_path(spark, "csv")
    L.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    return L.read_csv(spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double")


@query("SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_name END AS n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def io_jsonl_joined(spark, sf_dir):
    """Two logs of JSON lines, NULL fields kept, put together line by line."""
    a, b, out = (new_path(spark, x) for x in ("a", "b", "out"))
    L.write_jsonl(table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("n_name")), a)
    L.write_jsonl(table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name")), b)
    L.concat_jsonl(spark, [a, b], out)
    return L.read_jsonl_strict(spark, out, "n_nationkey bigint, n_name string").select("n_nationkey", "n_name")


@query("SELECT DISTINCT id FROM fp_metadata WHERE id IS NOT NULL")
def io_id_list(spark, sf_dir):
    """Ids as lines below a head, with blank ones among them."""
    path = new_path(spark, "ids")
    ids = table(spark, sf_dir, "fp_metadata").select("id").where("id IS NOT NULL").distinct()
    ids.unionByName(spark.createDataFrame([("id",), ("",), ("  ",)], "id string")).write.text(path)
    return L.read_ids(spark, path, header="id")


@query("SELECT count(DISTINCT o_orderpriority) AS n_files, true AS all_dated, true AS all_filled FROM orders")
def io_listing(spark, sf_dir):
    """The files of a partitioned table, listed without being read."""
    path = new_path(spark, "parts")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    files = L.list_files(spark, path, "*.parquet")
    return files.agg(F.count("*").alias("n_files"), F.bool_and(F.col("modified").isNotNull()).alias("all_dated"), F.bool_and(F.col("length") > 0).alias("all_filled"))


@query("SELECT qid, 'N/A' AS answer FROM fm_item_questions")
def source_constant(spark, sf_dir):
    return L.constant_source(table(spark, sf_dir, "fm_item_questions"), "N/A").select("qid", F.get("resps", 0).alias("answer"))


@query("SELECT p_partkey FROM part ORDER BY sha256('11:' || p_partkey) LIMIT 50")
def sample_hashed(spark, sf_dir):
    """Fifty rows drawn by a seeded hash, the same wherever they lie."""
    return P.hash_sample(table(spark, sf_dir, "part"), "p_partkey", 50, 11).select("p_partkey")


@query("SELECT rec_no, replace(replace(path_v, ' ', '_'), '__', '_').lower() AS path FROM fp_metadata WHERE path_v IS NOT NULL")
def path_normalised(spark, sf_dir):
    return table(spark, sf_dir, "fp_metadata").where("path_v IS NOT NULL").select("rec_no", L.normalized_path(F.col("path_v")).alias("path"))


@query("SELECT rec_no, '<RESP> ' || activity || ' <TIME> 0.000-' || printf('%.3f', duration_s) || ' <RESP> end <TIME> ' || printf('%.3f', duration_s) || '-' || printf('%.3f', duration_s + 1) || ' ' AS text FROM fp_metadata WHERE activity IS NOT NULL AND duration_s IS NOT NULL")
def response_texts(spark, sf_dir):
    seg = lambda t, a, b: F.struct(t.alias("text"), a.alias("t0"), b.alias("t1"))
    d = F.col("duration_s")
    rows = table(spark, sf_dir, "fp_metadata").where("activity IS NOT NULL AND duration_s IS NOT NULL")
    return rows.select("rec_no", X.response_text(F.array(seg(F.col("activity"), F.lit(0.0), d), seg(F.lit("end"), d, d + 1))).alias("text"))


@query("""
    SELECT rec_no, CASE rec_no % 3 WHEN 0 THEN round(duration_s - 0.1, 6) WHEN 1 THEN round(duration_s + 2 - 0.1, 6) END AS t0, CASE rec_no % 3 WHEN 0 THEN round(duration_s + 1 + 0.1, 6) WHEN 1 THEN round(duration_s + 3 + 0.1, 6) END AS t1
    FROM (SELECT rec_no, floor(duration_s) AS duration_s FROM fp_metadata WHERE duration_s IS NOT NULL)
""")
def clip_times_parsed(spark, sf_dir):
    """The one clip, the second of two, and none for an odd number of marks."""
    d = F.floor("duration_s")
    mark = lambda k, n: F.concat(F.lit(k), (d + n).cast("string"), F.lit(".0"))
    one, two = F.concat(mark("s:", 0), F.lit(","), mark("e:", 1)), F.concat(mark("s:", 2), F.lit(","), mark("e:", 3))
    m = F.col("rec_no") % 3
    text = F.when(m == 0, one).when(m == 1, F.concat(one, F.lit(","), two)).otherwise(mark("s:", 0))
    rows = table(spark, sf_dir, "fp_metadata").where("duration_s IS NOT NULL").select("rec_no", L.clip_times(text).alias("c"))
    return rows.select("rec_no", F.round("c.t0", 6).alias("t0"), F.round("c.t1", 6).alias("t1"))


@query(rf"""
    WITH v AS (SELECT sample_no, trim(regexp_extract(coalesce(array_to_string(r, chr(10)), ''), '(?mi)FINAL_ANSWER\s*:\s*([^\n<]+)', 1)) AS v FROM {_ONE}),
    a AS (SELECT sample_no, regexp_replace(CASE WHEN length(v) >= 2 AND v[1] = v[-1] AND v[1] IN ('"', '''', '`') THEN trim(v[2:-2])
      WHEN length(v) >= 2 AND ((v[1] = '“' AND v[-1] = '”') OR (v[1] = '‘' AND v[-1] = '’')) THEN trim(v[2:-2]) ELSE v END, '[ .;:,`''"]+$', '') AS answer FROM v)
    SELECT sample_no, CASE WHEN answer IN ('drinking', 'feeding', 'shelf') THEN answer ELSE '' END AS answer FROM a
""")
def final_answer_allowed(spark, sf_dir):
    """Answers outside the vocabulary are none."""
    rows = log_rows(spark, sf_dir, "sample_log", "filtered_resps").withColumn("text", F.array_join("filtered_resps", "\n"))
    return rows.select("sample_no", X.final_answer(F.col("text"), ["drinking", "feeding", "shelf"]).alias("answer"))


@query(f"SELECT sample_no, pos, CAST(item_value AS INTEGER) AS qid, question_type, sampling FROM ({problems.ORACLES['p2_found']}) v LEFT JOIN fm_item_questions q ON q.qid = CAST(item_value AS INTEGER) WHERE field_name = 'qids'")
def join_question_metadata(spark, sf_dir):
    """Every question asked, with what is known of it; unknown ids keep NULLs."""
    asked = problems.p2_found(spark, sf_dir).where("field_name = 'qids'").select("sample_no", "pos", F.col("item_value").cast("int").alias("qid"))
    return asked.join(table(spark, sf_dir, "fm_item_questions").select("qid", "question_type", "sampling"), "qid", "left").select("sample_no", "pos", "qid", "question_type", "sampling")
