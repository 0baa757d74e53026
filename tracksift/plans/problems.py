"""Queries of the general problems over the project's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksift.operators.drift import field_changes, profiled_fields, unified
from tracksift.operators.intervals import periods_and_gaps, time_spans, to_ms
from tracksift.operators.nested import stored_tables, tagged_rows
from tracksift.operators.packed import packed_values
from tracksift.sources.tables import log_rows, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of every video's markers and of every sample's spans.

    A redelivered row covers what its first delivery covers, so rows needn't
    be made unique first.
    """
    marks = table(spark, sf_dir, "label_track").select(
        F.lit("label_track").alias("origin"), F.col("id").alias("entity"),
        to_ms(F.col("Time_s")).alias("start_ms"), to_ms(F.col("Time_s") + F.col("hold_s")).alias("end_ms"),
    ).where("NOT isnan(Time_s) AND NOT isnan(hold_s)")
    spans = table(spark, sf_dir, "sample_log").where("filtered_resps IS NOT NULL").select(
        F.lit("sample_log").alias("origin"), F.col("sample_no").cast("string").alias("entity"),
        F.inline(time_spans(F.array_join("filtered_resps", "\n"))),
    )
    return periods_and_gaps(marks.unionByName(spans), ["origin", "entity"], "start_ms", "end_ms")


def qid_number(value: str) -> str:
    """The number of a question id as ``7``, ``q7`` or ``Q07``; '' if it has none."""
    digits = "".join(c for c in value if c.isdigit() and c.isascii())
    return str(int(digits)) if digits else ""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_rows(spark, sf_dir, "sample_log", "task", "qids", "filtered_resps").withColumn(
        "filtered_resps", F.when(F.col("task").startswith("strokerehab_primitives"), F.col("filtered_resps"))
    ).where("qids IS NOT NULL OR filtered_resps IS NOT NULL")
    values = packed_values(
        rows.drop("task"), "sample_no", {"qids": True, "filtered_resps": False}, {"qids": qid_number, "filtered_resps": label_value}
    )
    return values.select("sample_no", "field_name", "pos", "item_value")


def label_value(value: str) -> str:
    """A ``label@seconds`` value as it is; '' for a slot that holds none, as ``[invalid]``."""
    return value if "@" in value else ""


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field how many values it packs and how many of them were malformed."""
    rows = log_rows(spark, sf_dir, "sample_log", "qids", "filtered_resps").where("qids IS NOT NULL OR filtered_resps IS NOT NULL")
    values = packed_values(rows, "sample_no", {"qids": True, "filtered_resps": False})
    return values.groupBy("field_name").agg(F.count("*").alias("n_values"), F.count_if("malformed").alias("n_malformed"))


def _run_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return stored_tables(tagged_rows(log_rows(spark, sf_dir, "run_log", "results", "configs")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [t.where("NOT again").select("run_no", "task", F.lit(tag).alias("kind"), "parent_pos", "pos", "entry_name") for tag, t in _run_tables(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, rows)


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of scores, typed."""
    return _run_tables(spark, sf_dir)["score"].select("run_no", "task", F.col("entry_name").alias("field"), "value_type", F.expr("try_cast(value AS double)").alias("number"))


def p3_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter steps by the name of the filter that their parent key leads to."""
    tables = _run_tables(spark, sf_dir)
    filters = tables["filter"].select(F.col("row_key").alias("parent_key"), F.col("entry_name").alias("filter_name"), "n_steps")
    steps = tables["step"].where("NOT again").select("parent_key", "run_no", "task", "pos", F.col("entry_name").alias("function"))
    joined = steps.join(filters, "parent_key", "left")
    return joined.groupBy("run_no", "task", "filter_name").agg(F.count("*").alias("n_steps"), F.max("n_steps").alias("n_said"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = log_rows(spark, sf_dir, "run_log", "series", "written_at", "results")
    return field_changes(profiled_fields(runs, texts=False)).select("run_no", "task", "change_kind", "old_field", "new_field").distinct()


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every file under one name per field."""
    fields = profiled_fields(log_rows(spark, sf_dir, "run_log", "series", "written_at", "results"))
    return unified(fields, field_changes(fields))



QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_flags, p3_found, p3_scores, p3_steps, p6_found, p6_unified)}

def _unpacked_sql(x: str) -> str:
    """JSON kept as a text, unpacked."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND trim({x}->>'$')[1:1] IN ('[', '{{') THEN coalesce(TRY_CAST({x}->>'$' AS JSON), {x}) ELSE {x} END"


def _entries_sql(source: str, keep: str, value: str, name: str) -> str:
    """(keep, pos, name, x) of a list in any of its shapes."""
    return f"""(
      SELECT {keep}, generate_subscripts(l, 1) - 1 AS pos, unnest(list_transform(l, lambda e: CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.{name}') WHEN json_type(e) = 'NULL' THEN NULL ELSE e->>'$' END)) AS name, unnest(l) AS x
      FROM (SELECT {keep}, list_transform(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]')
          WHEN json_type(v) = 'OBJECT' AND NOT list_contains(json_keys(v), '{name}') AND len(list_filter(json_keys(v), lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0 THEN list_transform(json_keys(v), lambda k: json_extract(v, '$."' || k || '"'))
          ELSE [v] END, lambda e: {_unpacked_sql("e")}) AS l
        FROM (SELECT {keep}, {_unpacked_sql(value)} AS v FROM {source}) WHERE v IS NOT NULL AND json_type(v) <> 'NULL'))"""


_TABLES = f"""
    WITH d AS (SELECT DISTINCT ON (run_no) run_no, TRY_CAST(results AS JSON) AS r, TRY_CAST(configs AS JSON) AS c FROM run_log),
    t AS (SELECT run_no, unnest(json_keys(r)) AS task, r FROM d WHERE json_type(r) = 'OBJECT'),
    u AS (SELECT run_no, task, {_unpacked_sql("x")} AS x FROM (SELECT run_no, task, json_extract(r, '$."' || task || '"') AS x FROM t)),
    c AS (SELECT run_no, unnest(json_keys(c)) AS task, c FROM d WHERE json_type(c) = 'OBJECT'),
    b AS (SELECT run_no, task, {_unpacked_sql("x")} AS x FROM (SELECT run_no, task, json_extract(c, '$."' || task || '"') AS x FROM c)),
    o AS (SELECT run_no, task, x, {_unpacked_sql("json_extract(x, '$.task')")} AS s FROM b WHERE json_type(x) = 'OBJECT'),
    g AS (SELECT run_no, task, s FROM o WHERE json_type(s) IN ('ARRAY', 'OBJECT') OR (json_type(s) = 'VARCHAR' AND list_contains(json_keys(x), 'group'))),
    s AS (SELECT * FROM {_entries_sql("g", "run_no, task", "s", "task")} WHERE name IS NOT NULL),
    k AS (SELECT run_no, task, x FROM o UNION ALL SELECT run_no, name, x FROM s WHERE json_type(x) = 'OBJECT'),
    m AS (SELECT * FROM {_entries_sql("(SELECT run_no, task, json_extract(x, '$.metric_list') AS y FROM k)", "run_no, task", "y", "metric")} WHERE name IS NOT NULL),
    f AS (SELECT * FROM {_entries_sql("(SELECT run_no, task, json_extract(x, '$.filter_list') AS y FROM k)", "run_no, task", "y", "name")} WHERE name IS NOT NULL),
    p AS (SELECT * FROM {_entries_sql("(SELECT run_no, task, pos AS parent, json_extract(x, '$.filter') AS y FROM f WHERE json_type(x) = 'OBJECT')", "run_no, task, parent", "y", "function")} WHERE name IS NOT NULL)
"""


ORACLES = {
    "p3_steps": _TABLES + """
    SELECT p.run_no, p.task, n.name AS filter_name, count(*) AS n_steps, CAST(max(n) AS BIGINT) AS n_said FROM (SELECT DISTINCT run_no, task, parent, pos, name FROM p) p
    JOIN (SELECT run_no, task, parent, any_value(f.name) AS name, count(DISTINCT p.pos) AS n FROM p JOIN f USING (run_no, task) WHERE f.pos = parent GROUP BY run_no, task, parent) n USING (run_no, task, parent) GROUP BY p.run_no, p.task, n.name
    """,
    "p3_found": _TABLES + """
    SELECT run_no, task, 'score' AS kind, -1::BIGINT AS parent_pos, -1::BIGINT AS pos, unnest(json_keys(x)) AS entry_name FROM u WHERE json_type(x) = 'OBJECT'
    UNION SELECT run_no, task, 'subtask', -1, pos, name FROM s UNION SELECT run_no, task, 'metric', -1, pos, name FROM m
    UNION SELECT run_no, task, 'filter', -1, pos, name FROM f UNION SELECT run_no, task, 'step', parent, pos, name FROM p
    """,
    "p3_scores": r"""
    WITH d AS (SELECT DISTINCT ON (run_no) run_no, TRY_CAST(results AS JSON) AS j FROM run_log),
    t AS (SELECT run_no, unnest(json_keys(j)) AS task, j FROM d WHERE json_type(j) = 'OBJECT'),
    u AS (SELECT run_no, task, json_extract(j, '$."' || replace(task, '"', '\"') || '"') AS x FROM t),
    v AS (SELECT run_no, task, CASE WHEN json_type(x) = 'VARCHAR' AND trim(x->>'$') LIKE '{%' THEN coalesce(TRY_CAST(x->>'$' AS JSON), x) ELSE x END AS x FROM u),
    f AS (SELECT run_no, task, unnest(json_keys(x)) AS field, x FROM v WHERE json_type(x) = 'OBJECT'),
    g AS (SELECT run_no, task, field, json_extract(x, '$."' || replace(field, '"', '\"') || '"') AS y FROM f)
    SELECT run_no, task, field, CASE json_type(y) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS value_type,
      CASE WHEN json_type(y) NOT IN ('ARRAY', 'OBJECT', 'NULL', 'BOOLEAN') THEN TRY_CAST(y->>'$' AS DOUBLE) END AS number FROM g
    """,
    "p2_found": r"""
    WITH d AS (SELECT DISTINCT ON (sample_no) sample_no, task, qids, filtered_resps FROM sample_log),
    f AS (
      SELECT sample_no, 'qids' AS field_name, 0 AS e, qids AS t FROM d WHERE qids IS NOT NULL
      UNION ALL SELECT sample_no, 'filtered_resps', generate_subscripts(filtered_resps, 1), unnest(filtered_resps) FROM d WHERE task LIKE 'strokerehab_primitives%'),
    b AS (SELECT sample_no, field_name, e, regexp_replace(trim(t, ' ' || chr(10) || chr(9) || chr(13)), '(?s)^[\[({](.*)[\])}]$', '\1') AS t FROM f),
    s AS (SELECT sample_no, field_name, e, regexp_extract_all(t, CASE WHEN field_name = 'qids'
       THEN '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|<SEP>|[^\s,;|/"''&<]+'
       ELSE '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|<SEP>|(?:[^,;|/\t\n<"'']|<[^S])+' END) AS l FROM b),
    v AS (SELECT sample_no, field_name, e, generate_subscripts(l, 1) AS i, trim(unnest(l)) AS x FROM s),
    u AS (SELECT sample_no, field_name, e, i, trim(CASE WHEN x LIKE '"%"' AND length(x) > 1 THEN replace(x[2:-2], '""', '"') WHEN x LIKE '''%''' AND length(x) > 1 THEN replace(x[2:-2], '''''', '''') ELSE x END) AS x FROM v WHERE x <> '<SEP>'),
    k AS (SELECT sample_no, field_name, e, i, CASE WHEN field_name = 'qids' THEN ltrim(regexp_replace(x, '[^0-9]', '', 'g'), '0') ELSE x END AS x, x AS raw FROM u),
    g AS (SELECT sample_no, field_name, e, i, CASE WHEN field_name = 'qids' AND x = '' AND regexp_matches(raw, '[0-9]') THEN '0' ELSE x END AS x FROM k)
    SELECT sample_no, field_name, CAST(row_number() OVER (PARTITION BY sample_no, field_name ORDER BY e, i) - 1 AS BIGINT) AS pos, x AS item_value
    FROM g WHERE x <> '' AND (field_name = 'qids' OR contains(x, '@'))
    """,
    "p1_found": r"""
    WITH spans AS (
      SELECT sample_no, unnest(regexp_extract_all(array_to_string(filtered_resps, chr(10)),
        '(?i)<\s*TIME\s*>\s*[0-9:.]+\s*s?\s*(?:-|–|—|to)\s*[0-9:.]+')) AS x
      FROM sample_log WHERE filtered_resps IS NOT NULL),
    ends AS (
      SELECT sample_no, string_split(regexp_extract(x, '>\s*([0-9:.]+)', 1), ':') AS a,
        string_split(regexp_extract(x, '(?:-|–|—|to)\s*([0-9:.]+)$', 1), ':') AS b FROM spans),
    iv AS (
      SELECT 'label_track' AS origin, id AS entity, CAST(floor(Time_s * 1000 + 0.5) AS BIGINT) AS s,
        CAST(floor((Time_s + hold_s) * 1000 + 0.5) AS BIGINT) AS e FROM label_track
      WHERE id IS NOT NULL AND Time_s IS NOT NULL AND hold_s IS NOT NULL
      UNION ALL
      SELECT 'sample_log', CAST(sample_no AS VARCHAR),
        CAST(floor(list_reduce(list_transform(a, lambda v: CAST(v AS DOUBLE)), lambda p, q: p * 60 + q) * 1000 + 0.5) AS BIGINT),
        CAST(floor(list_reduce(list_transform(b, lambda v: CAST(v AS DOUBLE)), lambda p, q: p * 60 + q) * 1000 + 0.5) AS BIGINT)
      FROM ends),
    reach AS (
      SELECT *, max(e) OVER (PARTITION BY origin, entity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
      FROM iv WHERE s < e),
    island AS (
      SELECT *, sum(CASE WHEN m >= s THEN 0 ELSE 1 END) OVER (PARTITION BY origin, entity ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM reach),
    period AS (SELECT origin, entity, k, min(s) AS s, max(e) AS e FROM island GROUP BY origin, entity, k)
    SELECT origin, entity, 'period' AS kind, s AS start_ms, e AS end_ms FROM period
    UNION ALL
    SELECT * FROM (
      SELECT origin, entity, 'gap', e, lead(s) OVER (PARTITION BY origin, entity ORDER BY s) AS n FROM period) WHERE n IS NOT NULL
    """,
}
