"""Queries on texts and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksift.functions import text as X
from tracksift.functions.times import ntz_ms
from tracksift.operators import responses as R
from tracksift.operators.metrics import sequence_hash
from tracksift.plans.catalog import query
from tracksift.sources.tables import log_rows, table

_ONE = "(SELECT sample_no, any_value(task) AS task, any_value(doc_id) AS doc_id, any_value(run_no) AS run_no, any_value(id) AS id, any_value(target) AS target, any_value(filtered_resps) AS r, any_value(input) AS input, any_value(accuracy) AS accuracy, any_value(doc_hash) AS doc_hash FROM sample_log GROUP BY sample_no)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_rows(spark, sf_dir, "sample_log", "filtered_resps", "task", "input", "target")
    return rows.withColumn("text", F.array_join("filtered_resps", "\n"))


@query(rf"""
    WITH v AS (SELECT sample_no, trim(regexp_extract(coalesce(array_to_string(r, chr(10)), ''), '(?mi)FINAL_ANSWER\s*:\s*([^\n<]+)', 1)) AS v FROM {_ONE})
    SELECT sample_no, regexp_replace(CASE WHEN length(v) >= 2 AND v[1] = v[-1] AND v[1] IN ('"', '''', '`') THEN trim(v[2:-2])
      WHEN length(v) >= 2 AND ((v[1] = '“' AND v[-1] = '”') OR (v[1] = '‘' AND v[-1] = '’')) THEN trim(v[2:-2]) ELSE v END, '[ .;:,`''"]+$', '') AS answer
    FROM v
""")
def final_answer_extract(spark, sf_dir):
    return _answers(spark, sf_dir).select("sample_no", X.final_answer(F.col("text")).alias("answer"))


@query(rf"""
    WITH c AS (SELECT sample_no, unnest(string_split_regex(array_to_string(r, chr(10)), '(?i)<\s*RESP\s*>')) AS c,
        generate_subscripts(string_split_regex(array_to_string(r, chr(10)), '(?i)<\s*RESP\s*>'), 1) AS i FROM {_ONE}),
    b AS (SELECT sample_no, c, row_number() OVER (PARTITION BY sample_no ORDER BY i) - 1 AS block FROM c
        WHERE regexp_matches(c, '(?i)<\s*TIME\s*>\s*([0-9.]+)\s*-\s*([0-9.]+)')),
    a AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(c, '(?i)<\s*TIME\s*>\s*([0-9.]+)\s*-\s*([0-9.]+)', '', 'g'), '(?i)<\s*SEP\s*>'), lambda x: regexp_replace(x, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')), lambda x: x <> '') AS l FROM b)
    SELECT sample_no, CAST(block AS BIGINT) AS block, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS answer_no, unnest(l) AS answer,
      TRY_CAST(regexp_extract(c, '(?i)<\s*TIME\s*>\s*([0-9.]+)\s*-\s*([0-9.]+)', 1) AS DOUBLE) AS t0,
      TRY_CAST(regexp_extract(c, '(?i)<\s*TIME\s*>\s*([0-9.]+)\s*-\s*([0-9.]+)', 2) AS DOUBLE) AS t1 FROM a
""")
def block_parse(spark, sf_dir):
    blocks = _answers(spark, sf_dir).select("sample_no", F.inline(X.response_blocks(F.col("text"))))
    return blocks.select("sample_no", F.col("block").cast("bigint").alias("block"), F.col("answer_no").cast("bigint").alias("answer_no"), "answer", "t0", "t1")


@query(rf"""
    SELECT sample_no, CASE WHEN contains(lower(t), 'yes') THEN true WHEN contains(lower(t), 'no') THEN false END AS yes_no,
      TRY_CAST(nullif(regexp_extract(t, '\b([012])\b', 1), '') AS INTEGER) AS lone_digit,
      TRY_CAST(nullif(regexp_extract(t, '(?i)FINAL_(?:SCORE|ANSWER)[^0-9]*([012])\s*$', 1), '') AS INTEGER) AS final_digit
    FROM (SELECT sample_no, array_to_string(r, chr(10)) AS t FROM {_ONE})
""")
def answer_tokens_scan(spark, sf_dir):
    t = F.col("text")
    return _answers(spark, sf_dir).select("sample_no", X.yes_no(t).alias("yes_no"), X.lone_digit(t).alias("lone_digit"), X.final_digit(t).alias("final_digit"))


@query(r"""
    WITH t AS (SELECT doc_id, trim(regexp_replace(replace(translate(lower(text), ',?', ''), '''s', ' ''s'), '[\n\t]', ' ', 'g')) AS t FROM documents),
    p AS (SELECT doc_id, t, list_reduce(list_prepend(t, list_transform(string_split(';/[]"{}()=+\_-><@`,?!', ''), lambda c: c)),
      lambda acc, c: CASE WHEN contains(t, c || ' ') OR contains(t, ' ' || c) OR regexp_matches(t, '[0-9](,)[0-9]') THEN replace(acc, c, '') ELSE replace(acc, c, ' ') END) AS o FROM t),
    q AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(o, '(^|[^0-9])\.+', '\1', 'g'), '\.+([^0-9.]|$)', '\1', 'g'), '^\.', '') AS o FROM p)
    SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(trim(o), ' +'), lambda w: w NOT IN ('a', 'an', 'the', '')),
      lambda w: CASE w WHEN 'none' THEN '0' WHEN 'zero' THEN '0' WHEN 'one' THEN '1' WHEN 'two' THEN '2' WHEN 'three' THEN '3' WHEN 'four' THEN '4' WHEN 'five' THEN '5'
        WHEN 'six' THEN '6' WHEN 'seven' THEN '7' WHEN 'eight' THEN '8' WHEN 'nine' THEN '9' WHEN 'ten' THEN '10' {_CONTRACTED} ELSE w END), ' ') AS answer FROM q
""".replace("{_CONTRACTED}", " ".join("WHEN '" + k.replace("'", "''") + "' THEN '" + v.replace("'", "''") + "'" for k, v in X.contraction_table().items())))
def vqa_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.answer_tokens(F.col("text")).alias("answer"))


@query(r"""
    SELECT p_partkey, 'brand=' || p_brand || ',size=' || p_size || ',price=' || CAST(p_retailprice AS DECIMAL(12,2)) || ',big=' || CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS args,
      'str' AS brand_kind, 'int' AS size_kind, 'float' AS price_kind, 'bool' AS big_kind, p_brand AS brand_value, CAST(p_size AS VARCHAR) AS size_value FROM part
""")
def args_parse(spark, sf_dir):
    args = F.concat(F.lit("brand="), "p_brand", F.lit(",size="), F.col("p_size").cast("string"), F.lit(",price="), F.col("p_retailprice").cast("decimal(12,2)").cast("string"),
                    F.lit(",big="), F.when(F.col("p_size") > 25, "True").otherwise("False"))
    rows = table(spark, sf_dir, "part").select("p_partkey", args.alias("args")).withColumn("m", X.typed_args(F.col("args")))
    kind, value = (lambda k: F.col("m")[k]["kind"].alias(f"{k}_kind")), (lambda k: F.col("m")[k]["value"].alias(f"{k}_value"))
    return rows.select("p_partkey", "args", kind("brand"), kind("size"), kind("price"), kind("big"), value("brand"), value("size"))


@query(r"""
    SELECT run_no, regexp_replace(model_name, '[^A-Za-z0-9_.\-]', '_', 'g') AS safe_name,
      CASE WHEN length(series) <= 15 THEN series ELSE series[1:5] || ' ... ' || series[-5:] END AS short_series,
      regexp_replace(model_name, '[^A-Z]', '', 'g') AS capitals, sha256(coalesce(results, '')) AS results_hash,
      epoch_ms(strptime(regexp_extract(file_name, '([0-9]{8}_[0-9]{6})', 1), '%Y%m%d_%H%M%S')) AS stamp_ms,
      CAST(strlen(coalesce(results, '')) AS BIGINT) AS n_bytes
    FROM (SELECT DISTINCT run_no, model_name, series, results, file_name FROM run_log)
""")
def name_functions(spark, sf_dir):
    rows = log_rows(spark, sf_dir, "run_log", "model_name", "series", "results", "file_name")
    results = F.coalesce("results", F.lit(""))
    stamp = F.to_timestamp_ntz(F.regexp_extract("file_name", "([0-9]{8}_[0-9]{6})", 1), F.lit("yyyyMMdd_HHmmss"))
    return rows.select("run_no", X.sanitized_name(F.col("model_name")).alias("safe_name"), X.elided(F.col("series"), 15).alias("short_series"), X.capitals(F.col("model_name")).alias("capitals"),
                       F.sha2(results, 256).alias("results_hash"), ntz_ms(stamp).alias("stamp_ms"), F.octet_length(results).cast("bigint").alias("n_bytes"))


@query(r"""
    SELECT marker_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS clock,
      round_even(hold_s, 1) AS hold_even
    FROM (SELECT DISTINCT marker_id, hold_s, CAST(floor(Time_s * 1000 + 0.5) AS BIGINT) AS ms FROM label_track) WHERE ms IS NOT NULL
""")
def clock_functions(spark, sf_dir):
    rows = log_rows(spark, sf_dir, "label_track", "Time_s", "hold_s").where("Time_s IS NOT NULL")
    return rows.select("marker_id", X.clock(F.col("Time_s")).alias("clock"), F.bround("hold_s", 1).alias("hold_even"))


@query(r"""
    SELECT doc_id, sha256(coalesce(text, '')) AS doc_hash, CASE WHEN text IS NULL THEN 0 ELSE strlen(text) END AS n_bytes,
      regexp_replace(coalesce(text, ''), '[0-9]', '', 'g') = coalesce(text, '') AS no_digits FROM documents
""")
def hash_sample(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("doc_hash"), F.octet_length(t).cast("bigint").alias("n_bytes"), (F.regexp_replace(t, "[0-9]", "") == t).alias("no_digits"))


@query("""
    SELECT task, sha256(coalesce(string_agg(doc_hash, '' ORDER BY doc_id, sample_no), '')) AS task_hash FROM (SELECT DISTINCT sample_no, task, doc_id, doc_hash FROM sample_log) GROUP BY task
""")
def hash_task(spark, sf_dir):
    """A task's hash over its samples' hashes in order."""
    rows = log_rows(spark, sf_dir, "sample_log", "task", "doc_id", "doc_hash")
    return sequence_hash(rows, ["task"], ["doc_id", "sample_no"], "doc_hash").withColumnRenamed("hash", "task_hash")


# --- response filters -------------------------------------------------------

_TOKENS = f"(SELECT sample_no, string_split(input, ' ') AS r FROM {_ONE} WHERE input IS NOT NULL)"


def _tokens(spark, sf_dir):
    return log_rows(spark, sf_dir, "sample_log", "input").where("input IS NOT NULL").select("sample_no", F.split("input", " ").alias("r"))


def _filtered(spark, sf_dir, *steps):
    rows = R.apply_pipelines(_tokens(spark, sf_dir), "r", {"out": list(steps)})
    return rows.select("sample_no", F.array_join(F.col("filtered")["out"], "|").alias("out"))


@query(f"SELECT sample_no, r[1] AS out FROM {_TOKENS}")
def filter_take_first(spark, sf_dir):
    return _filtered(spark, sf_dir, ("take_first", {}))


@query(f"SELECT sample_no, CASE WHEN len(r) >= 20 THEN array_to_string(r[1:20], '|') END AS out FROM {_TOKENS}")
def filter_take_k(spark, sf_dir):
    return _filtered(spark, sf_dir, ("take_first_k", {"k": 20}))


@query(f"SELECT sample_no, upper(lower(replace(array_to_string(r, '|'), 'ß', 'ss'))) AS out FROM {_TOKENS}")
def filter_lower_upper(spark, sf_dir):
    return _filtered(spark, sf_dir, ("lowercase", {}), ("uppercase", {}))


@query(f"SELECT sample_no, regexp_replace(f, '^ ', '') AS out FROM (SELECT sample_no, r[1] AS f FROM (SELECT sample_no, r FROM {_ONE} WHERE r IS NOT NULL))")
def filter_strip_one(spark, sf_dir):
    rows = log_rows(spark, sf_dir, "sample_log", "filtered_resps").where("filtered_resps IS NOT NULL")
    rows = R.apply_pipelines(rows, "filtered_resps", {"out": [("take_first", {}), ("remove_whitespace", {})]})
    return rows.select("sample_no", F.try_element_at(F.col("filtered")["out"], F.lit(1)).alias("out"))


@query(f"SELECT sample_no, array_to_string(list_transform(r, lambda x: CASE x WHEN 'the' THEN 'THE' WHEN 'and' THEN '&' ELSE '-' END), '|') AS out FROM {_TOKENS}")
def filter_map(spark, sf_dir):
    return _filtered(spark, sf_dir, ("map", {"table": {"the": "THE", "and": "&"}, "default": "-"}))


@query(f"""
    SELECT sample_no, arg_max(w, n * 100000 - p) AS out FROM (
      SELECT sample_no, w, count(*) AS n, min(p) AS p FROM (SELECT sample_no, unnest(r) AS w, generate_subscripts(r, 1) AS p FROM {_TOKENS}) GROUP BY sample_no, w)
    GROUP BY sample_no
""")
def filter_majority_vote(spark, sf_dir):
    return _filtered(spark, sf_dir, ("majority_vote", {}))


@query(rf"SELECT sample_no, coalesce(trim(regexp_extract_all(input, '([0-9]+) (?:frames|pictures|Bild)', 1)[-1]), '[invalid]') AS out FROM {_ONE} WHERE input IS NOT NULL")
def filter_regex(spark, sf_dir):
    rows = log_rows(spark, sf_dir, "sample_log", "input").where("input IS NOT NULL").withColumn("r", F.array("input"))
    rows = R.apply_pipelines(rows, "r", {"out": [("regex", {"pattern": "([0-9]+) (?:frames|pictures|Bild)", "group_select": -1})]})
    return rows.select("sample_no", F.col("filtered")["out"][0].alias("out"))


@query(r"""
    WITH c AS (SELECT doc_id, text, list_filter(list_transform([('cup', 0), ('comb', 1), ('jar', 2), ('shelf', 3)], lambda x: {'at': instr(lower(text), x[1]), 'i': x[2]}), lambda h: h.at > 0) AS h FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, coalesce('(' || coalesce(nullif(regexp_extract(text, '\(([A-Z])\)', 1), ''), chr(CAST(list_min(h).i + 65 AS INTEGER)), nullif(regexp_extract(text, ':\s*([A-Z])\b', 1), '')) || ')', '[invalid]') AS out FROM c
""")
def filter_multi_choice(spark, sf_dir):
    choices = F.array(*[F.lit(x) for x in ("cup", "comb", "jar", "shelf")])
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array("text").alias("r"))
    rows = R.apply_pipelines(rows, "r", {"out": [("multi_choice", {"choices": choices})]})
    return rows.select("doc_id", F.col("filtered")["out"][0].alias("out"))


@query(r"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    e AS (SELECT list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM eval_items WHERE text IS NOT NULL),
    dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
    eg AS (SELECT DISTINCT array_to_string(w[i:i+7], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM e))
    SELECT DISTINCT doc_id FROM dg WHERE g IN (SELECT g FROM eg)
""")
def decontam_ngram(spark, sf_dir):
    return R.ngram_overlap(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "text", 8)
