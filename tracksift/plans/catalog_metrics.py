"""Queries on metrics, aggregates, statistics, samples, windows, state, joins and shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracksift.operators import grouped as G
from tracksift.operators import metrics as M
from tracksift.operators.bootstrap import bootstrap
from tracksift.operators import sampling as P
from tracksift.operators import selection as C
from tracksift.operators import state as K
from tracksift.operators import stats as Z
from tracksift.operators import windows as W
from tracksift.plans.catalog import half_up, query, sql_draw, sql_mean
from tracksift.plans.catalog_sequences import EV, events
from tracksift.sources.tables import log_rows, table

_ONE = "(SELECT DISTINCT sample_no, task, id, target, accuracy, run_no FROM sample_log)"


def r6(c, name):
    return half_up(c).alias(name)


# --- metrics ----------------------------------------------------------------


@query("""
    SELECT rec_no, CAST(patient = id[1:6] AS INTEGER)::DOUBLE AS exact,
      CAST(lower(regexp_replace(regexp_replace(patient, '[^A-Za-z0-9 ]', '', 'g'), ' ', '', 'g')) = lower(id[1:6]) AS INTEGER)::DOUBLE AS loose FROM fp_metadata
""")
def metric_exact_match(spark, sf_dir):
    gold = F.substring("id", 1, 6)
    return table(spark, sf_dir, "fp_metadata").select(
        "rec_no", M.exact_match(F.col("patient"), gold).alias("exact"), M.exact_match(F.col("patient"), gold, ["[^A-Za-z0-9 ]", " "], case=False, punctuation=False).alias("loose"))


@query(r"""
    WITH s AS (SELECT rec_no, list_max(list_transform(['feeding', 'deodorant', 'toothbrush'], lambda g: 1 - levenshtein(lower(trim(regexp_replace(activity, '\s+', ' ', 'g'))), g) / CAST(greatest(length(activity), length(g), 1) AS DOUBLE))) AS s FROM fp_metadata)
    SELECT rec_no, round(CASE WHEN s < 0.5 THEN 0 ELSE s END, 6) AS anls FROM s
""")
def metric_anls(spark, sf_dir):
    golds = F.array(*[F.lit(x) for x in ("feeding", "deodorant", "toothbrush")])
    return table(spark, sf_dir, "fp_metadata").select("rec_no", r6(M.anls(F.col("activity"), golds), "anls"))


_LOSS = "(SELECT vec_id, list_transform(embedding[1:4], lambda x: abs(x)::DOUBLE) AS l, list_transform(embedding[5:8], lambda x: abs(x)::DOUBLE) AS u, label % 4 AS gold FROM embeddings)"


def _losses(spark, sf_dir):
    part = lambda a: F.transform(F.slice("embedding", a, 4), lambda x: F.abs(x).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", part(1).alias("l"), part(5).alias("u"), (F.col("label") % 4).alias("gold"))


@query(f"SELECT vec_id, (list_position(l, list_min(l)) - 1 = gold)::INTEGER::DOUBLE AS acc, (list_position(list_transform(l, lambda x, i: x / i), list_min(list_transform(l, lambda x, i: x / i))) - 1 = gold)::INTEGER::DOUBLE AS acc_norm FROM {_LOSS}")
def metric_mc_accuracy(spark, sf_dir):
    lengths = F.array(*[F.lit(float(i)) for i in (1, 2, 3, 4)])
    return _losses(spark, sf_dir).select("vec_id", M.choice_accuracy(F.col("l"), F.col("gold")).alias("acc"), M.choice_accuracy(F.col("l"), F.col("gold"), lengths).alias("acc_norm"))


@query(f"SELECT vec_id, (list_position(d, list_max(d)) - 1 = gold)::INTEGER::DOUBLE AS acc FROM (SELECT vec_id, gold, list_transform(l, lambda x, i: x - u[i]) AS d FROM {_LOSS})")
def metric_mutual_info(spark, sf_dir):
    return _losses(spark, sf_dir).select("vec_id", M.mutual_information_accuracy(F.col("l"), F.col("u"), F.col("gold")).alias("acc"))


@query(f"SELECT round(avg(list_sum(list_transform(l, lambda x, i: pow(x / list_sum(l) - CASE WHEN i - 1 = gold THEN 1 ELSE 0 END, 2)))), 6) AS brier FROM {_LOSS}")
def metric_brier(spark, sf_dir):
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + x)
    return _losses(spark, sf_dir).withColumn("t", total).select(M.brier(F.transform("l", lambda x: x / F.col("t")), F.col("gold")).alias("b")).agg(r6(F.avg("b"), "brier"))


@query("""
    WITH b AS (SELECT o_orderstatus = 'F' AS g, o_orderpriority < '3' AS p FROM orders),
    c AS (SELECT sum((g AND p)::INT)::DOUBLE tp, sum((NOT g AND NOT p)::INT)::DOUBLE tn, sum((NOT g AND p)::INT)::DOUBLE fp, sum((g AND NOT p)::INT)::DOUBLE fn FROM b)
    SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM c
""")
def metric_binary(spark, sf_dir):
    g, p = F.col("o_orderstatus") == "F", F.col("o_orderpriority") < "3"
    return table(spark, sf_dir, "orders").agg(r6(M.f1(g, p), "f1"), r6(M.matthews(g, p), "mcc"), r6(F.avg((g == p).cast("double")), "accuracy"))


@query("SELECT o_orderstatus AS gold, o_orderpriority[1:1] AS pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY o_orderstatus, o_orderpriority[1:1]")
def metric_confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1))
    return M.confusion(rows, "o_orderstatus", "p").withColumn("share", F.round("share", 6))


@query("""
    WITH x AS (SELECT l_returnflag AS g, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'R' END AS p FROM lineitem),
    l AS (SELECT DISTINCT g AS label FROM x UNION SELECT DISTINCT p FROM x),
    c AS (SELECT label, (SELECT count(*) FROM x WHERE g = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS np, (SELECT count(*) FROM x WHERE g = label AND p = label) AS tp FROM l)
    SELECT label, round(coalesce(tp / nullif(np, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(tp / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(np + support, 0)::DOUBLE, 0), 6) AS f1, support FROM c
""")
def metric_report(spark, sf_dir):
    p = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_linenumber") % 2 == 0, "A").otherwise("R")
    rows = M.report(M.confusion(table(spark, sf_dir, "lineitem").withColumn("p", p), "l_returnflag", "p"))
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("""
    SELECT l_returnflag, round(exp(-avg(l_discount)), 6) AS perplexity, round(sum(l_discount) / sum(l_quantity), 6) AS weighted_mean, round(exp(-(sum(l_discount) / sum(l_quantity))), 6) AS weighted_perplexity,
      round(-(sum(l_discount) / sum(l_quantity)) / ln(2), 6) AS bits_per_byte, 999.0 AS bypass FROM lineitem GROUP BY l_returnflag
""")
def metric_perplexity_family(spark, sf_dir):
    v, w, a = F.col("l_discount"), F.col("l_quantity"), M.AGGREGATIONS
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        r6(a["perplexity"](v), "perplexity"), r6(a["weighted_mean"](v, w), "weighted_mean"), r6(a["weighted_perplexity"](v, w), "weighted_perplexity"),
        r6(a["bits_per_byte"](v, w), "bits_per_byte"), a["bypass"](v).alias("bypass"))


@query("""
    WITH x AS (SELECT CASE WHEN stroke IS NULL THEN NULL ELSE stroke END AS g, CASE WHEN patient IS NULL THEN NULL ELSE upper(patient) LIKE '%S%' END AS p FROM fp_metadata)
    SELECT round(2 * sum((g AND p)::INT) / CAST(sum((g AND p IS NOT NULL)::INT) + sum((p AND g IS NOT NULL)::INT) AS DOUBLE), 6) AS f1, round(sum((g IS NOT NULL AND p IS NOT NULL)::INT) / count(*)::DOUBLE, 6) AS coverage,
      round(2 * sum((coalesce(g, p) AND p)::INT) / CAST(sum((coalesce(g, p) AND p IS NOT NULL)::INT) + sum(p::INT) AS DOUBLE), 6) AS f1_high,
      round(2 * sum((coalesce(g, NOT p) AND p)::INT) / CAST(sum((coalesce(g, NOT p) AND p IS NOT NULL)::INT) + sum(p::INT) AS DOUBLE), 6) AS f1_low FROM x
""")
def metric_masked_f1_bounds(spark, sf_dir):
    return table(spark, sf_dir, "fp_metadata").agg(*[F.round(c, 6).alias(n) for c, n in zip(
        M.masked_f1(F.col("stroke"), F.upper("patient").contains("S")), ("f1", "coverage", "f1_high", "f1_low"))])


@query("""
    SELECT vec_id, round(CASE WHEN w <= 0 OR h <= 0 THEN 0 ELSE w * h / (2 - w * h) END, 6) AS iou FROM (
      SELECT vec_id, greatest(1 - abs(embedding[1]::DOUBLE), 0) AS w, greatest(1 - abs(embedding[2]::DOUBLE), 0) AS h FROM embeddings)
""")
def metric_iou(spark, sf_dir):
    x, y, one, zero = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), F.lit(1.0), F.lit(0.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(M.iou([zero, zero, one, one], [x, y, x + 1.0, y + 1.0]), "iou"))


# --- aggregates -------------------------------------------------------------


@query(f"SELECT task, list_extract(list(accuracy ORDER BY sample_no), CAST(count(accuracy) // 2 + 1 AS BIGINT)) AS mid, round(quantile_cont(accuracy, 0.5), 6) AS median FROM {_ONE} WHERE accuracy IS NOT NULL GROUP BY task")
def agg_median_unsorted(spark, sf_dir):
    rows = log_rows(spark, sf_dir, "sample_log", "task", "accuracy").where("accuracy IS NOT NULL")
    mids = M.arrival_median(rows, ["task"], "sample_no", "accuracy")
    return mids.join(rows.groupBy("task").agg(r6(M.median(F.col("accuracy")), "median")), "task")


@query(f"SELECT task, round({sql_mean("accuracy")}, 6) AS mean, round(stddev_samp(accuracy) / sqrt(count(accuracy)), 6) AS stderr, count(accuracy) AS n FROM {_ONE} GROUP BY task")
def agg_se(spark, sf_dir):
    v = F.col("accuracy")
    return log_rows(spark, sf_dir, "sample_log", "task", "accuracy").groupBy("task").agg(r6(M.mean(v), "mean"), r6(M.stderr(v), "stderr"), F.count(v).alias("n"))


_TASKS = f"(SELECT task, stddev_samp(accuracy) / sqrt(count(accuracy)) AS se, {sql_mean("accuracy")} AS v, count(accuracy) AS n FROM {_ONE} GROUP BY task)"


@query(f"SELECT round(sqrt(sum((n - 1) * se * se * n) / (sum(n) - count(n)) / sum(n)), 6) AS pooled FROM {_TASKS}")
def agg_pooled_se(spark, sf_dir):
    v = F.col("accuracy")
    rows = log_rows(spark, sf_dir, "sample_log", "task", "accuracy").groupBy("task").agg(M.stderr(v).alias("se"), F.count(v).alias("n"))
    return rows.agg(r6(M.pooled_stderr(F.col("se"), F.col("n")), "pooled"))


@query(f"""
    WITH s AS (SELECT s_suppkey, s_nationkey, {sql_mean("l_discount")} AS v, stddev_samp(l_discount) / sqrt(count(*)) AS se, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    a AS (SELECT 'n' || s_nationkey AS g, * FROM s UNION ALL SELECT 'r' || n_regionkey, s.* FROM s JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'all', * FROM s)
    SELECT g AS "group", 'discount' AS metric, round(sum(v * n) / sum(n), 6) AS value, round(sqrt(sum((n - 1) * se * se * n) / (sum(n) - count(n)) / sum(n)), 6) AS stderr, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY g
""")
def agg_group_rollup(spark, sf_dir):
    """Suppliers rolled up to nations, regions and the whole."""
    v = F.col("l_discount")
    leaf = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(M.mean(v).alias("value"), M.stderr(v).alias("stderr"), F.count("*").alias("n"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    scores = leaf.select(name("s", "l_suppkey").alias("node"), F.lit("discount").alias("metric"), "value", "stderr", "n")
    edges = table(spark, sf_dir, "supplier").select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("node"))
    edges = edges.unionByName(table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("node")))
    edges = edges.unionByName(table(spark, sf_dir, "region").select(F.lit("all").alias("parent"), name("r", "r_regionkey").alias("node")))
    out = M.rollup_groups(scores, edges)
    return out.select("group", "metric", r6(F.col("value"), "value"), r6(F.col("stderr"), "stderr"), "n")


@query()
def agg_bootstrap_se(spark, sf_dir):
    """Of each task's median accuracy, over 100,000 rounds."""
    rows = log_rows(spark, sf_dir, "sample_log", "task", "accuracy")
    return bootstrap(rows, ["task"], ["accuracy"], "median")


@query("""
    SELECT id, arg_min(patient, rec_no) FILTER (WHERE patient IS NOT NULL) AS patient, arg_min(stroke, rec_no) FILTER (WHERE stroke IS NOT NULL) AS stroke,
      arg_min(activity, rec_no) FILTER (WHERE activity IS NOT NULL) AS activity FROM fp_metadata GROUP BY id
""")
def agg_first_nonnull(spark, sf_dir):
    return G.first_values(table(spark, sf_dir, "fp_metadata"), ["id"], "rec_no", ["patient", "stroke", "activity"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 3")
def agg_nth(spark, sf_dir):
    return G.nth_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 2)


@query("SELECT id, rec_no FROM (SELECT id, rec_no, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN subsampled_test_set THEN 0 ELSE 1 END, rec_no) AS r FROM fp_metadata) WHERE r = 1")
def dedupe_keep_first(spark, sf_dir):
    """The preferred row per id: an aggregate of the least key, combined before the shuffle."""
    rows = table(spark, sf_dir, "fp_metadata").select("id", "rec_no", "subsampled_test_set")
    return G.preferred_rows(rows, ["id"], [F.when(F.col("subsampled_test_set"), 0).otherwise(1), F.col("rec_no")]).select("id", "rec_no")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag")
def agg_quantiles(spark, sf_dir):
    q = M.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.95])
    return q.select("l_returnflag", r6(F.col("q0"), "p50"), r6(F.col("q1"), "p95"))


@query("""
    SELECT activity, grid AS limit_s, CAST(sum((duration_s <= grid)::INT) AS BIGINT) AS n, round(100.0 * sum((duration_s <= grid)::INT) / count(*), 6) AS pct
    FROM fp_metadata, (SELECT unnest([10.0, 20.0, 40.0, 80.0])::DOUBLE AS grid) WHERE duration_s IS NOT NULL GROUP BY ALL
""")
def agg_cdf_table(spark, sf_dir):
    rows = G.cumulative_table(table(spark, sf_dir, "fp_metadata"), ["activity"], "duration_s", [10, 20, 40, 80])
    return rows.select("activity", "limit_s", "n", r6(F.col("pct"), "pct"))


@query(f"""
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, round({sql_mean("o_totalprice")}, 6) AS mean, round(stddev_samp(o_totalprice), 6) AS sd, round(stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS sem
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
""")
def agg_multi_stats(spark, sf_dir):
    rows = G.described(table(spark, sf_dir, "orders"), [["o_orderstatus"], ["o_orderpriority"], []], "o_totalprice")
    return rows.select("o_orderstatus", "o_orderpriority", "n", *[r6(F.col(c), c) for c in ("mean", "sd", "sem")])


@query("SELECT activity, arg_max(height, n * 100000 - height) AS mode_height, max(n) AS mode_n FROM (SELECT activity, height, count(*) AS n FROM fp_metadata WHERE height IS NOT NULL GROUP BY ALL) GROUP BY activity")
def agg_mode(spark, sf_dir):
    return G.modes(table(spark, sf_dir, "fp_metadata"), ["activity"], "height").select("activity", F.col("mode").alias("mode_height"), "mode_n")


_GRID = """
    g AS (SELECT n_nationkey AS k, seg FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer)),
    p AS (SELECT c_nationkey AS k, c_mktsegment AS seg, CAST(count(*) % 3 AS INTEGER) AS pred FROM customer WHERE c_acctbal > 9000 GROUP BY ALL),
    j AS (SELECT g.k, g.seg, p.pred, (g.k + length(g.seg)) % 3 AS gold FROM g LEFT JOIN p ON g.k = p.k AND g.seg = p.seg)
"""


def _grid(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pred = c.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg")).agg((F.count("*") % 3).cast("int").alias("pred"))
    rows = G.grid_filled(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), c.select(F.col("c_mktsegment").alias("seg")), pred, ["k", "seg"])
    return rows.withColumn("gold", (F.col("k") + F.length("seg")) % 3)


@query(f"WITH {_GRID} SELECT round(sum(CASE WHEN pred = gold THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS accuracy, count(pred) AS answered, count(*) AS cells FROM j")
def agg_grid_accuracy(spark, sf_dir):
    """A missing prediction is no hit and counts in the denominator."""
    out = _grid(spark, sf_dir).agg(*G.grid_accuracy(F.col("pred"), F.col("gold")))
    return out.select(r6(F.col("accuracy"), "accuracy"), "answered", "cells")


@query(f"WITH {_GRID} SELECT round(avg(apd), 6) AS apd, round(avg(mtsd), 6) AS mtsd FROM (SELECT k, sum(coalesce(abs(pred - gold), 2)) AS apd, abs(coalesce(sum(pred), 0) - sum(gold)) + 2 * count(*) FILTER (WHERE pred IS NULL) AS mtsd FROM j GROUP BY k)")
def agg_apd_mtsd(spark, sf_dir):
    return G.subject_errors(_grid(spark, sf_dir), "k", "pred", "gold").select(r6(F.col("apd"), "apd"), r6(F.col("mtsd"), "mtsd"))


@query(f"SELECT task, min(a) = 1 AS all_right, round(avg(a), 6) AS share FROM (SELECT task, id, min((accuracy > 0.2)::INT) AS a FROM {_ONE} WHERE accuracy IS NOT NULL GROUP BY ALL) GROUP BY task")
def agg_acc_all(spark, sf_dir):
    """Share of (task, id) groups whose every answer is right."""
    rows = log_rows(spark, sf_dir, "sample_log", "task", "id", "accuracy").where("accuracy IS NOT NULL")
    per = rows.groupBy("task", "id").agg(F.min((F.col("accuracy") > 0.2).cast("int")).alias("a"))
    return per.groupBy("task").agg((F.min("a") == 1).alias("all_right"), r6(F.avg("a"), "share"))


# --- statistics -------------------------------------------------------------


@query("""
    WITH x AS (SELECT l_returnflag, sum((l_discount > 0.05)::INT)::DOUBLE AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 / (1 + 3.8416 / n) * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)), 6) AS low,
      round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 / (1 + 3.8416 / n) * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)), 6) AS high FROM x
""")
def stat_wilson(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("k"), F.count("*").cast("double").alias("n"))
    low, high = Z.wilson(F.col("k"), F.col("n"))
    return x.select("l_returnflag", r6(low, "low"), r6(high, "high"))


@query("""
    WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY ALL),
    g AS (SELECT a.r, b.c, a.nr, b.nc, t.n FROM (SELECT r, sum(n) AS nr FROM c GROUP BY r) a, (SELECT c, sum(n) AS nc FROM c GROUP BY c) b, (SELECT sum(n) AS n FROM c) t)
    SELECT round(sum(pow(coalesce(c.n, 0) - nr * nc / g.n::DOUBLE, 2) / (nr * nc / g.n::DOUBLE)), 6) AS chi2, (count(DISTINCT g.r) - 1) * (count(DISTINCT g.c) - 1) AS dof FROM g LEFT JOIN c ON g.r = c.r AND g.c = c.c
""")
def stat_chi2(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return Z.chi_square(cells, "o_orderstatus", "o_orderpriority", "n").select(r6(F.col("chi2"), "chi2"), "dof")


@query(f"""
    WITH p AS (SELECT l_linenumber AS test, {sql_mean("l_discount")} * 0.5 AS p FROM lineitem GROUP BY l_linenumber), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS m FROM p)
    SELECT test, round(p, 6) AS p, round(max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY p, test), 6) AS p_holm FROM r
""")
def stat_holm(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("test")).agg((M.mean(F.col("l_discount")) * 0.5).alias("p"))
    return Z.holm(p, "p").select("test", r6(F.col("p"), "p"), r6(F.col("p_holm"), "p_holm"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(1 - sum(pow(l_quantity - l_extendedprice, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2_identity FROM lineitem")
def stat_regression(spark, sf_dir):
    a, b, c = Z.identity_regression(F.col("l_quantity"), F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").agg(r6(a, "slope"), F.round(b, 4).alias("intercept"), r6(c, "r2_identity"))


# --- samples and order ------------------------------------------------------


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= ceil(n * 0.1)")
def limit_fraction(spark, sf_dir):
    return P.limit_fraction(table(spark, sf_dir, "orders"), "o_orderkey", 0.1).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 3 AND i < 5000")
def shard_stride(spark, sf_dir):
    return P.stride_shard(table(spark, sf_dir, "orders"), "o_orderkey", 3, 7, 5000).select("o_orderkey")


@query("SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS BIGINT) AS part FROM orders")
def split_balanced(spark, sf_dir):
    return P.balanced_split(table(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "part")


@query(f"""
    WITH p AS (SELECT p_partkey AS shot, row_number() OVER (ORDER BY p_partkey) AS spot, count(*) OVER () AS n FROM part),
    d AS (SELECT s_suppkey, j, floor(j * n / 4.0)::BIGINT AS low, floor((j + 1) * n / 4.0)::BIGINT AS high FROM supplier, range(4) t(j), (SELECT max(n) AS n FROM p)),
    a AS (SELECT s_suppkey, j, 1 + low + {sql_draw(5, "at", "s_suppkey", "j")} % (high - low) AS spot FROM d),
    r AS (SELECT s_suppkey, shot, row_number() OVER (PARTITION BY s_suppkey ORDER BY {sql_draw(5, "order", "s_suppkey", "j")}, j) AS r FROM a JOIN p USING (spot) WHERE shot <> s_suppkey)
    SELECT s_suppkey, CAST(r - 1 AS INTEGER) AS shot_no, shot AS p_partkey FROM r WHERE r <= 3
""")
def fewshot_sample(spark, sf_dir):
    return P.fewshot(table(spark, sf_dir, "supplier"), "s_suppkey", table(spark, sf_dir, "part"), "p_partkey", 3, 5)


@query("SELECT model_name, list_aggregate(list_transform(regexp_extract_all(model_name, '([0-9]+|[^0-9]+)', 1), lambda p: CASE WHEN p SIMILAR TO '[0-9].*' THEN lpad(length(regexp_replace(p, '^0+([0-9])', '\\1'))::VARCHAR, 10, '0') || regexp_replace(p, '^0+([0-9])', '\\1') ELSE lower(p) END), 'string_agg', '') AS sort_key FROM (SELECT DISTINCT model_name FROM run_log WHERE model_name IS NOT NULL)")
def sort_natural(spark, sf_dir):
    return table(spark, sf_dir, "run_log").select("model_name").where("model_name IS NOT NULL").distinct().select("model_name", P.natural_key(F.col("model_name")).alias("sort_key"))


@query(f"SELECT l_returnflag, l_suppkey, CAST(r AS INTEGER) AS place, round(v, 6) AS v FROM (SELECT l_returnflag, l_suppkey, {sql_mean('l_discount')} AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY {sql_mean('l_discount')} DESC, l_suppkey) AS r FROM lineitem GROUP BY l_returnflag, l_suppkey) WHERE r <= 2")
def topk_best_second(spark, sf_dir):
    means = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(M.mean(F.col("l_discount")).alias("v"))
    return G.top_rows(means, ["l_returnflag"], [F.desc("v"), F.asc("l_suppkey")], 2).select("l_returnflag", "l_suppkey", "place", r6(F.col("v"), "v"))


# --- frame windows and state ------------------------------------------------

_META = "(SELECT rec_no, CAST(floor(duration_s * fps) AS BIGINT) AS n, fps FROM fp_metadata WHERE duration_s IS NOT NULL AND fps IS NOT NULL)"


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "fp_metadata").where("duration_s IS NOT NULL AND fps IS NOT NULL").select("rec_no", F.floor(F.col("duration_s") * F.col("fps")).alias("n"), "fps")


@query(f"SELECT rec_no, i * 120 AS \"first\", least(i * 120 + 160, n) AS \"last\" FROM (SELECT rec_no, n, unnest(range(0, CAST(greatest(ceil((n - 160) / 120.0), 0) + 1 AS BIGINT))) AS i FROM {_META} WHERE n > 0)")
def win_dense_overlap(spark, sf_dir):
    return _frames(spark, sf_dir).select("rec_no", F.inline(W.dense_windows(F.col("n"), 32, 8, 5)))


@query(f"SELECT rec_no, i * 64 AS \"first\", least(i * 64 + 64, n) AS \"last\" FROM (SELECT rec_no, n, unnest(range(0, CAST(greatest(ceil((n - 64) / 64.0), 0) + 1 AS BIGINT))) AS i FROM {_META} WHERE n > 0)")
def win_dense(spark, sf_dir):
    return _frames(spark, sf_dir).select("rec_no", F.inline(W.dense_windows(F.col("n"), 64)))


@query(f"SELECT rec_no, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS i, unnest(f) AS frame FROM (SELECT rec_no, CASE WHEN n < 16 THEN range(0, greatest(n, 1)) ELSE list_transform(range(0, 16), lambda i: CAST(floor(i * (n - 1) / 15.0) AS BIGINT)) END AS f FROM {_META})")
def win_uniform(spark, sf_dir):
    return _frames(spark, sf_dir).select("rec_no", F.posexplode(W.uniform_frames(F.col("n"), 16)).alias("i", "frame"))


@query(f"SELECT user_id, min(CASE WHEN s >= 900 THEN t END) AS reached_at FROM (SELECT user_id, t, sum(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM {EV}) GROUP BY user_id")
def win_threshold_time(spark, sf_dir):
    return W.threshold_time(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", "t", 900)


@query(f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM {EV}),
    s AS (SELECT user_id, event_id, i, event_type IN ('click', 'purchase') AS motion FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN s.motion THEN e.event_type <> 'view' ELSE e.event_type IN ('click', 'purchase') END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
    SELECT user_id, event_id, motion FROM s
""")
def state_fold(spark, sf_dir):
    """Motion starts at a click or purchase and, once on, ends at a view."""
    e = F.col("event_type")
    rows = K.two_flag_states(events(spark, sf_dir), ["user_id"], ["t", "event_id"], {"motion": e.isin("click", "purchase")}, {"motion": e == "view"})
    return rows.select("user_id", "event_id", "motion")


def _fill_sql(n: int, src: str, element: str) -> str:
    """CTEs that fill windows of four frames one after the other."""
    return f"""
    h{n} AS (SELECT user_id, p // 4 AS w, arg_min(label, p) = '{element}' AS has, count(*) AS size, lead(arg_min(label, p) = '{element}') OVER (PARTITION BY user_id ORDER BY p // 4) AS nxt FROM {src} GROUP BY user_id, p // 4),
    r{n} AS (SELECT user_id, w, has AS now, false AS filled FROM h{n} WHERE w = 0
      UNION ALL SELECT h.user_id, h.w, h.has OR (r.now AND (coalesce(h.nxt, false) OR h.size < 4)), r.now AND (coalesce(h.nxt, false) OR h.size < 4) FROM r{n} r JOIN h{n} h ON h.user_id = r.user_id AND h.w = r.w + 1),
    f{n} AS (SELECT x.user_id, event_id, p, CASE WHEN filled THEN '{element}' ELSE label END AS label FROM {src} x JOIN r{n} r ON r.user_id = x.user_id AND r.w = x.p // 4)"""


@query(f"""
    WITH RECURSIVE f0 AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS p, CASE WHEN event_type IN ('click', 'view') THEN 'idle' WHEN event_type = 'error' THEN 'reach' ELSE 'transport' END AS label FROM {EV}),
    {_fill_sql(1, "f0", "transport")}, {_fill_sql(2, "f1", "idle")},
    b AS (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY p) AS bef FROM f2),
    c AS (SELECT user_id, p, CASE label WHEN 'transport' THEN 'reach' ELSE 'reposition' END AS put, row_number() OVER (PARTITION BY user_id ORDER BY p) AS i FROM b WHERE (bef = 'idle' AND label = 'transport') OR (bef = 'transport' AND label = 'idle')),
    k AS (SELECT user_id, i, p, put, p AS prev, true AS kept FROM c WHERE i = 1
      UNION ALL SELECT c.user_id, c.i, c.p, c.put, CASE WHEN c.p > k.prev + 2 THEN c.p ELSE k.prev END, c.p > k.prev + 2 FROM k JOIN c ON c.user_id = k.user_id AND c.i = k.i + 1),
    z AS (SELECT f2.user_id, f2.event_id, arg_max(k.put, k.p) AS put FROM f2 JOIN k ON k.kept AND k.user_id = f2.user_id AND f2.p >= k.p - 2 AND f2.p < k.p + 2 GROUP BY f2.user_id, f2.event_id)
    SELECT f2.user_id, f2.event_id, coalesce(put, label) AS label FROM f2 LEFT JOIN z USING (user_id, event_id)
""")
def win_smooth(spark, sf_dir):
    e = F.col("event_type")
    label = F.when(e.isin("click", "view"), "idle").when(e == "error", "reach").otherwise("transport")
    return K.smooth(events(spark, sf_dir).withColumn("label", label), "user_id", ["t", "event_id"], "label", ["transport", "idle"], 4).select("user_id", "event_id", "label")


@query()
def track_iou(spark, sf_dir):
    """Boxes from the vectors: 8 to a frame of a label's video."""
    v = F.col("embedding")
    x, y = (v[0] * 10).cast("double"), (v[1] * 10).cast("double")
    boxes = table(spark, sf_dir, "embeddings").select(F.col("label"), F.floor(F.col("vec_id") / 80).alias("frame"), F.col("vec_id").alias("box"), x.alias("x1"), y.alias("y1"), (x + 3.0).alias("x2"), (y + 3.0).alias("y2"))
    return K.track_boxes(boxes, "label")


# --- joins, sets and shapes -------------------------------------------------


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE s_name LIKE '%1' AND n_name NOT IN ('NATION_3', 'NATION_7')")
def join_dimensions(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").where(F.col("s_name").rlike("1$"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.where(~F.col("n_name").isin("NATION_3", "NATION_7")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("""
    SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def join_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    part = lambda how: c.join(o, "c_custkey", f"left_{how}").agg(F.count("*").alias("n")).select(F.lit(how).alias("kind"), "n")
    return part("semi").unionByName(part("anti"))


@query("""
    WITH w AS (UNPIVOT (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS A, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS N, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS R FROM lineitem GROUP BY l_suppkey) ON A, N, R INTO NAME flag VALUE n)
    SELECT s_suppkey, flag, n FROM supplier JOIN w ON s_suppkey = l_suppkey AND flag = CASE WHEN s_nationkey % 2 = 0 THEN 'A' ELSE 'R' END
""")
def join_lookup_wide(spark, sf_dir):
    """A wide table's column chosen by a value of the other side: unpivot, then an equi-join."""
    wide = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0)
    s = table(spark, sf_dir, "supplier")
    out = G.chosen_column(s, wide, ("s_suppkey", "l_suppkey"), ["A", "N", "R"], F.when(F.col("s_nationkey") % 2 == 1, "R"), "n")
    return out.where("n IS NOT NULL").select("s_suppkey", F.col("chosen").alias("flag"), "n")


@query("SELECT p_partkey FROM part WHERE (p_size BETWEEN 3 AND 17) OR (p_size BETWEEN 19 AND 30)")
def join_range_overlap(spark, sf_dir):
    """Rows whose range [size, size] meets a requested one of ``3-17,19-30``."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").where(C.range_overlap(size, size, "3-17,30-19")).select("p_partkey")


_LOGS = [f"strokerehab_identification_{i}" for i in (1, 2)] + ["strokerehab_ia3_lower", "strokerehab_ia3_upper"]


@query(f"""
    SELECT doc_id, {", ".join(f"max(CASE WHEN task = '{t}' THEN accuracy END) AS {t}" for t in _LOGS)}
    FROM (SELECT DISTINCT sample_no, task, doc_id, accuracy FROM sample_log) WHERE doc_id IS NOT NULL AND task IN ({", ".join(f"'{t}'" for t in _LOGS)}) GROUP BY doc_id HAVING count(DISTINCT task) >= 2
""")
def join_logs_align(spark, sf_dir):
    """What each of several logs says of a document, where two of them at least do."""
    return G.aligned_logs(log_rows(spark, sf_dir, "sample_log", "task", "doc_id", "accuracy"), "doc_id", "task", _LOGS, "accuracy")


@query("SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS F, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS O FROM lineitem GROUP BY l_returnflag")
def reshape_pivot(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))


@query("UNPIVOT (SELECT rec_no, CAST(height AS DOUBLE) AS height, CAST(width AS DOUBLE) AS width, fps FROM fp_metadata) ON height, width, fps INTO NAME field VALUE v")
def reshape_unpivot(spark, sf_dir):
    rows = table(spark, sf_dir, "fp_metadata").select("rec_no", F.col("height").cast("double").alias("height"), F.col("width").cast("double").alias("width"), "fps")
    return rows.unpivot(["rec_no"], ["height", "width", "fps"], "field", "v").where("v IS NOT NULL")


@query("""
    SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL
    SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
    SELECT 'except', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)
""")
def set_ops(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return named("union", c.union(s).distinct()).unionByName(named("intersect", c.intersect(s))).unionByName(named("except", n.subtract(s)))


@query(r"""
    WITH r AS (SELECT DISTINCT run_no, results FROM run_log WHERE json_valid(results)),
    t AS (SELECT run_no, unnest(json_keys(results)) AS task, results FROM r),
    f AS (SELECT run_no, task, unnest(json_keys(results, '$."' || task || '"')) AS field, results FROM t),
    v AS (SELECT run_no, task, field, TRY_CAST(results ->> ('$."' || task || '"."' || field || '"') AS DOUBLE) AS v FROM f WHERE contains(field, ','))
    SELECT a.run_no, a.task, split_part(a.field, ',', 1) AS metric, a.field[instr(a.field, ',') + 1:] AS filter, a.v AS value, b.v AS stderr
    FROM v a LEFT JOIN v b ON a.run_no = b.run_no AND a.task = b.task AND b.field = split_part(a.field, ',', 1) || '_stderr,' || a.field[instr(a.field, ',') + 1:]
    WHERE a.v IS NOT NULL AND NOT suffix(split_part(a.field, ',', 1), '_stderr')
""")
def results_long(spark, sf_dir):
    """Results as (task, metric, filter, value, stderr), by one aggregate instead of a self-join."""
    return G.results_table(log_rows(spark, sf_dir, "run_log", "results"), "run_no", "results")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS choice, conditional, round(x::DOUBLE, 6) AS loss FROM (SELECT vec_id, unnest([1, 2, 3, 4]) AS i, unnest(embedding[1:4]) AS x, true AS conditional FROM embeddings UNION ALL SELECT vec_id, unnest([1, 2, 3, 4]), unnest(embedding[5:8]), false FROM embeddings)")
def choice_expansion(spark, sf_dir):
    """One request per choice, and its unconditional copy, in one generator."""
    part = lambda at: F.transform(F.slice("embedding", at, 4), lambda x: x.cast("double"))
    out = G.choice_requests(table(spark, sf_dir, "embeddings"), "vec_id", part(1), part(5))
    return out.select("vec_id", "choice", "conditional", r6(F.col("text"), "loss"))