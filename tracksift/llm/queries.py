"""Queries of the language-model problems over the project's tables."""

from __future__ import annotations

import importlib.util
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksift.llm.languages import language_name, train_languages
from tracksift.llm.leaks import leaked_spans
from tracksift.llm.lookalike import consistent_texts, lookalike_classes, lookalike_pairs
from tracksift.llm.mixing import mix, source_name, token_counts
from tracksift.llm.pairs import answer_segments, pair_defects
from tracksift.llm.runs import Vocabulary, label_runs
from tracksift.llm.splits import deal_splits, patient_code, rooted_forest, with_person
from tracksift.operators.intervals import to_ms
from tracksift.session import materialize
from tracksift.sources.tables import table

# The five primitives with their spellings, and the activities.
PRIMITIVES = {"reach": ["reach"], "reposition": ["reposition", "retract"], "transport": ["transport"], "stabilize": ["stabilize", "stabilise"], "idle": ["idle", "rest"]}
ACTIVITIES = frozenset("buttoning cardsort deodorant drinking facewash feeding glasses haircomb jarlid shelf tabletop toothbrush".split())


def primitives() -> Vocabulary:
    return Vocabulary(PRIMITIVES)


def tokenizer_path() -> str:
    """The public rank file used where no other is given."""
    spec = importlib.util.find_spec("public_tokenizers")
    base = Path(spec.origin).parent if spec else Path("/opt/tokenizers")
    return str(base / "byte_bpe_50k.tiktoken")


def _people(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Rows of fp_metadata with their person; the code at the start of id is the right one."""
    links = table(spark, sf_dir, "patient_links").select(patient_code(F.col("code_a")).alias("a"), patient_code(F.col("code_b")).alias("b"))
    rows = table(spark, sf_dir, "fp_metadata").select("rec_no", "id", "patient", *keep)
    code = F.coalesce(patient_code(F.regexp_extract("id", "^[^_]*", 0)), patient_code(F.col("patient")))
    return with_person(rows, code, links, "a", "b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("rec_no", "patient_group")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of fp_metadata with its split; persons stay whole.

    Whether a row's patient had a stroke is told by the right code's letter;
    the activity by the name in id.
    """
    rows = materialize(_people(spark, sf_dir), "people")
    targets = [tuple(r) for r in table(spark, sf_dir, "split_targets").orderBy(F.desc("target_share"), "split_name").collect()]
    activity = F.regexp_extract("id", r"^[^_]*_([a-z]+)", 1)
    dealt = deal_splits(rows, "patient_group", [F.substring("id", 1, 1), activity], targets)
    to = dealt.select(F.col("patient_group").alias("_person"), "split_name")
    return rows.join(to, F.col("patient_group").eqNullSafe(F.col("_person"))).select("rec_no", "patient_group", "split_name")


def p4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per person with linked codes: the codes and the edges of their tree."""
    links = table(spark, sf_dir, "patient_links").select(patient_code(F.col("code_a")).alias("a"), patient_code(F.col("code_b")).alias("b"))
    codes, edges = rooted_forest(links, "a", "b")
    n_edges = edges.groupBy("person").agg(F.count("*").alias("n_edges"))
    n_codes = codes.groupBy("person").agg(F.count("*").alias("n_codes"))
    return n_codes.join(n_edges, "person", "left").select("person", "n_codes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "label_track").select(
        "id", F.lower(F.substring(F.regexp_extract("MarkerNames", r"(?i)(?<![a-z])(l|left|r|right)(?![a-z])", 1), 1, 1)).alias("hand"),
        "Time_s", "marker_id", "MarkerNames",
    ).where("hand <> ''")
    runs = label_runs(marks, ["id", "hand"], "Time_s", "marker_id", "MarkerNames", primitives)
    return runs.where("n_events >= 2").select(
        F.col("first_key").alias("first_marker_id"), F.col("last_key").alias("last_marker_id"),
        F.col("n_events").alias("n_markers"), to_ms(F.col("last_at") - F.col("first_at")).alias("span_ms"),
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_log").where(
        F.col("task").startswith("strokerehab_identification_") | F.col("task").startswith("strokerehab_ia3"))
    model = train_languages(table(spark, sf_dir, "documents"), "text", language_name(F.col("lang")))
    # a redelivered sample gives equal rows, and those are few: they are made unique rather than the texts
    return pair_defects(rows, "sample_no", "input", answer_segments(F.col("resps"), F.col("filtered_resps")), model, ACTIVITIES).distinct()


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked spans themselves, to be cut out."""
    return _leaks(spark, sf_dir)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    targets = [tuple(r) for r in table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").collect()]
    return mix(token_counts(docs, "text", tokenizer_path(), ["doc_id", "source"]), "doc_id", targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tokens of mixed scripts, or written whole in another script than they are read in."""
    forms = consistent_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return forms.where("n_mixed > 0 OR n_whole > 0").select("doc_id", "n_mixed", "n_whole")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with text, and its class of texts that look the same."""
    return lookalike_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p4_found, p4_splits, p4_forest, p5_found, p7_found, p8_found, p8_spans, p9_mix, p10_found, p10_classes, p10_flags)}

_CODE = "upper(regexp_extract({0}, '(?i)([SC])[^0-9A-Za-z]*[0-9]+', 1)) || lpad(ltrim(regexp_extract({0}, '(?i)[SC][^0-9A-Za-z]*([0-9]+)', 1), '0'), 5, '0')"

ORACLES: dict[str, str] = {
    "p4_found": f"""
    WITH RECURSIVE l AS (SELECT {_CODE.format('code_a')} AS a, {_CODE.format('code_b')} AS b FROM patient_links),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a, least(a, min(b)) AS person FROM r GROUP BY a),
    c AS (SELECT rec_no, coalesce({_CODE.format("regexp_extract(id, '^[^_]*')")}, {_CODE.format('patient')}) AS code FROM fp_metadata)
    SELECT rec_no, coalesce(person, code) AS patient_group FROM c LEFT JOIN m ON code = a
    """,
    "p4_forest": f"""
    WITH RECURSIVE l AS (SELECT {_CODE.format('code_a')} AS a, {_CODE.format('code_b')} AS b FROM patient_links),
    e AS (SELECT a, b FROM l WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a, least(a, min(b)) AS person FROM r GROUP BY a)
    SELECT person, count(*) AS n_codes, count(*) - 1 AS n_edges FROM m GROUP BY person
    """,
    "p5_found": r"""
    WITH d AS (SELECT DISTINCT marker_id, id, Time_s, MarkerNames FROM label_track WHERE id IS NOT NULL AND Time_s IS NOT NULL AND MarkerNames IS NOT NULL),
    h AS (SELECT *, lower(regexp_extract(' ' || MarkerNames, '(?i)[^a-z](l|left|r|right)([^a-z]|$)', 1))[1:1] AS hand FROM d),
    v AS (SELECT unnest(['reach', 'reposition', 'retract', 'transport', 'stabilize', 'stabilise', 'idle', 'rest']) AS w, unnest(['reach', 'reposition', 'reposition', 'transport', 'stabilize', 'stabilize', 'idle', 'idle']) AS p),
    n AS (SELECT DISTINCT MarkerNames FROM h), t AS (SELECT MarkerNames, unnest(regexp_extract_all(lower(MarkerNames), '[a-z]+')) AS k FROM n),
    b AS (SELECT MarkerNames, arg_min(p, damerau_levenshtein(k, w)) AS p FROM t, v WHERE damerau_levenshtein(k, w) <= CASE WHEN length(w) > 4 THEN 1 ELSE 0 END GROUP BY MarkerNames),
    m AS (SELECT id, hand, Time_s, marker_id, p, CASE WHEN lag(p) OVER w = p THEN 0 ELSE 1 END AS new FROM h JOIN b USING (MarkerNames) WHERE hand <> '' WINDOW w AS (PARTITION BY id, hand ORDER BY Time_s, marker_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY id, hand ORDER BY Time_s, marker_id ROWS UNBOUNDED PRECEDING) AS i FROM m)
    SELECT arg_min(marker_id, (Time_s, marker_id)) AS first_marker_id, arg_max(marker_id, (Time_s, marker_id)) AS last_marker_id, count(*) AS n_markers, CAST(floor((max(Time_s) - min(Time_s)) * 1000 + 0.5) AS BIGINT) AS span_ms
    FROM i GROUP BY id, hand, i HAVING count(*) >= 2
    """,
}
