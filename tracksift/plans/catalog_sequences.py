"""Queries on sequences, intervals and as-of joins; events stand in for label tracks
(user = video, event type = label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.functions.times import ntz_ms
from tracksift.operators import interval_joins as J
from tracksift.operators import metrics as M
from tracksift.operators import sequences as S
from tracksift.plans.catalog import half_up, query, sql_mean
from tracksift.sources.tables import log_rows, table

LABELS = ["click", "error", "purchase", "signup", "view"]
HOUR, DAY = 3_600_000, 86_400_000
#: Events with ms since the epoch, as SQL.
EV = "(SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, event_type, value FROM events)"
# an event's label as one of the five primitives
PRIM = "CASE event_type WHEN 'click' THEN 'reach' WHEN 'purchase' THEN 'transport' WHEN 'error' THEN 'stabilize' WHEN 'view' THEN 'UNK' ELSE 'idle' END"


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", ntz_ms(F.col("ts")).alias("t"), "event_type", "value")


def primitive() -> Column:
    e = F.col("event_type")
    return F.when(e == "click", "reach").when(e == "purchase", "transport").when(e == "error", "stabilize").when(e == "view", "UNK").otherwise("idle")


_HALVES = f"""
    c AS (SELECT *, t >= 1705276800000 AS late, lag(event_type) OVER (PARTITION BY user_id, t >= 1705276800000 ORDER BY t, event_id) AS p FROM {EV}),
    s AS (SELECT user_id, coalesce(string_agg(CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'B' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'D' ELSE 'E' END, '' ORDER BY t, event_id) FILTER (WHERE late), '') AS pred,
        coalesce(string_agg(CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'B' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'D' ELSE 'E' END, '' ORDER BY t, event_id) FILTER (WHERE NOT late), '') AS ref
      FROM c WHERE p IS NULL OR p <> event_type GROUP BY user_id),
    m AS (SELECT user_id, length(pred) AS n_pred, length(ref) AS n_ref, levenshtein(pred, ref) AS distance,
        list_sum(list_transform(['A', 'B', 'C', 'D', 'E'], lambda x: abs(length(pred) - length(replace(pred, x, '')) - length(ref) + length(replace(ref, x, ''))))) AS off FROM s),
    scored AS (SELECT user_id, n_pred, n_ref, distance, CASE WHEN greatest(n_pred, n_ref) = 0 THEN 100.0 ELSE (1 - distance / CAST(greatest(n_pred, n_ref) AS DOUBLE)) * 100 END AS edit_score,
        CASE WHEN n_ref = 0 THEN 0.0 ELSE distance / CAST(n_ref AS DOUBLE) END AS action_error_rate, CASE WHEN n_ref = 0 THEN 0.0 ELSE off / CAST(n_ref AS DOUBLE) END AS rce FROM m)
"""


@query(f"WITH {_HALVES} SELECT user_id, CAST(n_pred AS BIGINT) AS n_pred, CAST(n_ref AS BIGINT) AS n_ref, CAST(distance AS BIGINT) AS distance, round(edit_score, 6) AS edit_score, round(action_error_rate, 6) AS action_error_rate, round(rce, 6) AS rce FROM scored")
def seq_edit_score(spark, sf_dir):
    """Second half of the month against the first, per user."""
    late = F.col("t") >= 1705276800000
    item = F.struct("t", "event_id", "event_type")
    arrays = events(spark, sf_dir).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.when(late, item))).alias("p"), F.array_sort(F.collect_list(F.when(~late, item))).alias("r"))
    halves = arrays.select("user_id", F.transform("p", lambda x: x["event_type"]).alias("p"), F.transform("r", lambda x: x["event_type"]).alias("r"))
    scored = S.edit_scores(halves, "p", "r", LABELS)
    return scored.select("user_id", "n_pred", "n_ref", "distance", *[half_up(F.col(c)).alias(c) for c in ("edit_score", "action_error_rate", "rce")])


@query(f"""WITH {_HALVES} SELECT round({sql_mean("edit_score")}, 6) AS mean_score, round(stddev_samp(edit_score) / sqrt(count(*)), 6) AS se_score,
    round({sql_mean("action_error_rate")}, 6) AS mean_aer, round(stddev_samp(action_error_rate) / sqrt(count(*)), 6) AS se_aer, count(*) AS n FROM scored""")
def seq_edit_score_agg(spark, sf_dir):
    se = lambda c: F.round(F.stddev_samp(c) / F.sqrt(F.count("*")), 6)
    return seq_edit_score(spark, sf_dir).agg(
        half_up(M.mean(F.col("edit_score"))).alias("mean_score"), se("edit_score").alias("se_score"),
        half_up(M.mean(F.col("action_error_rate"))).alias("mean_aer"), se("action_error_rate").alias("se_aer"), F.count("*").alias("n"))


@query(f"SELECT user_id, event_id, t, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM {EV}) WHERE p IS NULL OR p <> event_type")
def seq_collapse(spark, sf_dir):
    return S.collapse(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type").select("user_id", "event_id", "t", "event_type")


@query(f"""
    SELECT user_id, string_agg(event_type || '@' || printf('%.3f', (t - 1704067200000) / 1000.0), ';' ORDER BY t, event_id) || ';' || arg_max(event_type, t * 1000000 + event_id) || '@' || printf('%.3f', (max(t) - 1704067200000) / 1000.0) AS code,
      CAST(count(*) AS BIGINT) AS n_labels, CAST(count(*) + 1 AS BIGINT) AS n_times FROM {EV} GROUP BY user_id
""")
def seq_codec_roundtrip(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type"))).alias("x"))
    times = F.transform("x", lambda x: (x["t"] - 1704067200000) / 1000.0)
    code = S.encode_track(F.transform("x", lambda x: x["event_type"]), F.concat(times, F.slice(times, -1, 1)))
    rows = rows.select("user_id", code.alias("code")).withColumn("d", S.decode_track(F.col("code")))
    return rows.select("user_id", "code", F.size("d.labels").cast("bigint").alias("n_labels"), F.size("d.times").cast("bigint").alias("n_times"))


_SEG = f"""
    k AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p, max(t) OVER (PARTITION BY user_id) AS e FROM {EV}),
    seg AS (SELECT * FROM (SELECT user_id, event_type AS label, t AS t0, coalesce(least(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), e), e) AS t1 FROM k WHERE p IS NULL OR p <> event_type) WHERE t1 > t0)
"""


def _segments(spark, sf_dir):
    return S.segments(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "t", "event_type")


@query(f"WITH {_SEG} SELECT user_id, label, t0, t1 FROM seg")
def seq_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(f"""
    WITH x AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'soft' ELSE 'hard' END AS label, t AS t0, t + 43200000 AS t1 FROM {EV}),
    n AS (SELECT *, CASE WHEN lag(label) OVER w = label AND lag(t1) OVER w >= t0 THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t0, t1, label)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t0, t1, label ROWS UNBOUNDED PRECEDING) AS i FROM n)
    SELECT user_id, any_value(label) AS label, min(t0) AS t0, max(t1) AS t1, count(*) AS n_parts FROM i GROUP BY user_id, i
""")
def seq_merge_touching(spark, sf_dir):
    soft = F.when(F.col("event_type").isin("click", "view", "signup"), "soft").otherwise("hard")
    segs = events(spark, sf_dir).select("user_id", soft.alias("label"), F.col("t").alias("t0"), (F.col("t") + 43200000).alias("t1"))
    return S.merge_touching(segs, ["user_id"])


_LOOK = """CASE WHEN m AND c = 1 THEN 'transport' WHEN m THEN CASE WHEN ahead = 1 THEN 'reach' ELSE 'reposition' END WHEN c = 1 THEN 'stabilize' ELSE 'idle' END"""


@query(f"""
    WITH f AS (SELECT *, event_type IN ('click', 'purchase', 'view') AS m, CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS c FROM {EV}),
    a AS (SELECT *, max(c) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 43200000 FOLLOWING) AS ahead FROM f)
    SELECT user_id, event_id, {_LOOK} AS label FROM a
""")
def seq_lookahead_labels(spark, sf_dir):
    e = F.col("event_type")
    rows = S.lookahead_labels(events(spark, sf_dir), ["user_id"], "t", e.isin("click", "purchase", "view"), e.isin("purchase", "error"), 12 * HOUR)
    return rows.select("user_id", "event_id", "label")


@query("\nUNION ALL\n".join(f"""
    SELECT CAST({h} AS BIGINT) AS hours, label, count(*) AS n FROM (
      SELECT {_LOOK} AS label FROM (SELECT *, max(c) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND {h * HOUR} FOLLOWING) AS ahead
        FROM (SELECT *, event_type IN ('click', 'purchase', 'view') AS m, CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS c FROM {EV}))) GROUP BY label
""" for h in (6, 12, 24, 48)))
def seq_lookahead_sweep(spark, sf_dir):
    """Label counts over a grid of look-ahead windows (a fixed list of four)."""
    e, out = F.col("event_type"), None
    for h in (6, 12, 24, 48):
        rows = S.lookahead_labels(events(spark, sf_dir), ["user_id"], "t", e.isin("click", "purchase", "view"), e.isin("purchase", "error"), h * HOUR)
        part = rows.groupBy("label").agg(F.count("*").alias("n")).select(F.lit(h).cast("bigint").alias("hours"), "label", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""
    WITH l AS (SELECT user_id, event_id, t, {PRIM} AS label FROM {EV}),
    n AS (SELECT *, first_value(CASE WHEN label IN ('transport', 'stabilize', 'idle') THEN label END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM l)
    SELECT user_id, event_id, CASE WHEN label = 'reach' AND (nxt IS NULL OR nxt = 'idle') THEN 'reposition' ELSE label END AS repaired FROM n
""")
def seq_backward_repair(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("label", primitive())
    return S.backward_repair(rows, ["user_id"], ["t", "event_id"], "label").select("user_id", "event_id", "repaired")


@query(f"""
    WITH l AS (SELECT user_id, event_id, CASE WHEN p IN ('idle', 'transport') THEN p ELSE 'UNK' END AS label, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total
      FROM (SELECT user_id, event_id, t, {PRIM} AS p FROM {EV})),
    k AS (SELECT *, max(CASE WHEN label <> 'UNK' THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS a, min(CASE WHEN label <> 'UNK' THEN n END) OVER (PARTITION BY user_id ORDER BY n DESC) AS b FROM l),
    j AS (SELECT k.*, x.label AS lf, y.label AS rt, k.n <= (coalesce(k.a, 0) + 1 + coalesce(k.b - 1, k.total)) // 2 AS early FROM k LEFT JOIN l x ON k.user_id = x.user_id AND k.a = x.n LEFT JOIN l y ON k.user_id = y.user_id AND k.b = y.n)
    SELECT user_id, event_id, CASE WHEN label <> 'UNK' THEN label WHEN lf IS NULL AND rt IS NULL THEN 'idle'
      WHEN lf = 'idle' AND rt = 'idle' THEN CASE WHEN early THEN 'reach' ELSE 'reposition' END WHEN lf = 'transport' AND rt = 'transport' THEN CASE WHEN early THEN 'reposition' ELSE 'reach' END
      WHEN rt = 'transport' THEN 'reach' ELSE 'reposition' END AS repaired FROM j
""")
def seq_unknown_runs(spark, sf_dir):
    p = primitive()
    rows = events(spark, sf_dir).withColumn("label", F.when(p.isin("idle", "transport"), p).otherwise("UNK"))
    return S.unknown_runs(rows, ["user_id"], ["t", "event_id"], "label").select("user_id", "event_id", "repaired")


@query(f"""
    WITH d AS (SELECT user_id, t // {DAY} AS day, arg_max(event_type, t * 1000000 + event_id) AS label FROM {EV} GROUP BY user_id, t // {DAY}),
    s AS (SELECT *, lead(day) OVER w - day AS step, lead(label) OVER w AS nl FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    c AS (SELECT user_id, step, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, step) AS r FROM s WHERE step IS NOT NULL GROUP BY user_id, step),
    l AS (SELECT user_id, max(CASE WHEN r = 1 THEN step END) AS s1, max(CASE WHEN r = 2 THEN step END) AS s2 FROM c GROUP BY user_id)
    SELECT user_id, day, label, false AS filled FROM d
    UNION ALL
    SELECT s.user_id, day + s1, CASE WHEN label = nl THEN label ELSE '' END, true FROM s JOIN l ON s.user_id = l.user_id WHERE step <> s1 AND (s2 IS NULL OR step <> s2)
""")
def seq_gap_fill(spark, sf_dir):
    last = F.max_by("event_type", F.struct("t", "event_id"))
    days = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("day")).agg(last.alias("label"))
    return S.gap_fill(days, ["user_id"], ["day"], "day", "label")


@query("""
    SELECT id, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right, CASE WHEN sum(l) > sum(r) THEN 'left' ELSE 'right' END AS side FROM (
      SELECT id, CASE WHEN lower(MarkerNames) LIKE 'l\\_%' ESCAPE '\\' THEN 1 ELSE 0 END + CASE WHEN contains(lower(MarkerNames), '_l_') THEN 1 ELSE 0 END AS l,
        CASE WHEN lower(MarkerNames) LIKE 'r\\_%' ESCAPE '\\' THEN 1 ELSE 0 END + CASE WHEN contains(lower(MarkerNames), '_r_') THEN 1 ELSE 0 END AS r
      FROM (SELECT DISTINCT marker_id, id, MarkerNames FROM label_track)) GROUP BY id
""")
def seq_side_inference(spark, sf_dir):
    left, right = S.hand_of(F.col("MarkerNames"), "l", "r")
    rows = log_rows(spark, sf_dir, "label_track", "id", "MarkerNames")
    counts = rows.groupBy("id").agg(F.sum(left).alias("n_left"), F.sum(right).alias("n_right"))
    return counts.withColumn("side", F.when(F.col("n_left") > F.col("n_right"), "left").otherwise("right"))


_MARK = """CASE WHEN contains(lower(MarkerNames), 'reach') THEN 'reach' WHEN contains(lower(MarkerNames), 'reposition') OR contains(lower(MarkerNames), 'retract') THEN 'reposition'
    WHEN contains(lower(MarkerNames), 'transport') THEN 'transport' WHEN contains(lower(MarkerNames), 'stabilize') THEN 'stabilize' WHEN contains(lower(MarkerNames), 'idle') OR contains(lower(MarkerNames), 'rest') THEN 'idle' END"""


@query(f"""
    WITH m AS (SELECT id, marker_id, CAST(floor(Time_s * 1000 + 0.5) AS BIGINT) AS t, {_MARK} AS label FROM (SELECT DISTINCT marker_id, id, Time_s, MarkerNames FROM label_track) WHERE Time_s IS NOT NULL),
    k AS (SELECT *, lag(label) OVER (PARTITION BY id ORDER BY t, marker_id) AS p, max(t) OVER (PARTITION BY id) AS e FROM m WHERE label IS NOT NULL)
    SELECT * FROM (SELECT id, label, t AS t0, coalesce(least(lead(t) OVER (PARTITION BY id ORDER BY t, marker_id), e), e) AS t1 FROM k WHERE p IS NULL OR p <> label) WHERE t1 > t0
""")
def seq_marker_segments(spark, sf_dir):
    t = F.floor(F.col("Time_s") * 1000 + 0.5)
    rows = log_rows(spark, sf_dir, "label_track", "id", "Time_s", "MarkerNames").where("Time_s IS NOT NULL").select("id", "marker_id", t.alias("t"), S.marker_label(F.col("MarkerNames")).alias("name"))
    return S.segments(rows.where("name IS NOT NULL"), ["id"], ["t", "marker_id"], "t", "name")


@query(f"""
    WITH {_SEG}, c AS (SELECT user_id, unnest(range(t0 // {DAY}, (t1 - 1) // {DAY} + 1)) AS chunk, label, t0, t1 FROM seg),
    r AS (SELECT user_id, chunk, label, row_number() OVER (PARTITION BY user_id, chunk ORDER BY greatest(t0, chunk * {DAY}) + least(t1, (chunk + 1) * {DAY}), t0, label) AS r, count(*) OVER (PARTITION BY user_id, chunk) AS n FROM c)
    SELECT user_id, chunk, label FROM r WHERE r = (n - 1) // 2 + 1
""")
def seq_chunk_labels(spark, sf_dir):
    return S.chunk_labels(_segments(spark, sf_dir), ["user_id"], DAY)


@query(f"""
    SELECT a AS from_label, b AS to_label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS share
    FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM {EV}) WHERE b IS NOT NULL GROUP BY a, b
""")
def seq_transition_matrix(spark, sf_dir):
    return S.transitions(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type").withColumn("share", F.round("share", 6))


@query(f"WITH {_SEG} SELECT label, count(*) AS n, sum(t1 - t0)::BIGINT AS total_ms, round(avg(t1 - t0), 6) AS mean_ms FROM seg GROUP BY label")
def seq_class_durations(spark, sf_dir):
    span = F.col("t1") - F.col("t0")
    return _segments(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.sum(span).alias("total_ms"), F.round(F.avg(span), 6).alias("mean_ms"))


_TWO = f"""{_SEG}, a AS (SELECT * FROM seg), b AS (SELECT user_id, label, t0 + 7200000 AS t0, t1 + 7200000 AS t1 FROM seg)"""


def _shifted(spark, sf_dir):
    return _segments(spark, sf_dir).withColumn("t0", F.col("t0") + 2 * HOUR).withColumn("t1", F.col("t1") + 2 * HOUR)


@query(f"""
    WITH {_TWO} SELECT a.user_id, sum(CASE WHEN a.label = b.label THEN least(a.t1, b.t1) - greatest(a.t0, b.t0) ELSE 0 END)::BIGINT AS matched_ms, sum(least(a.t1, b.t1) - greatest(a.t0, b.t0))::BIGINT AS joint_ms
    FROM a JOIN b ON a.user_id = b.user_id AND a.t0 < b.t1 AND b.t0 < a.t1 GROUP BY a.user_id
""")
def interval_match_time(spark, sf_dir):
    """Time two segmentations of one entity agree, over the time both cover."""
    pairs = J.overlap_join(_segments(spark, sf_dir), _shifted(spark, sf_dir), ["user_id"], DAY)
    span = F.col("t1") - F.col("t0")
    return pairs.groupBy("user_id").agg(F.sum(F.when(F.col("a_label") == F.col("b_label"), span).otherwise(0)).alias("matched_ms"), F.sum(span).alias("joint_ms"))


@query(f"""
    WITH {_SEG}, w AS (SELECT user_id, label, t0, t1, unnest(range(t0 // {DAY}, (t1 - 1) // {DAY} + 1)) AS win FROM seg)
    SELECT user_id, win, CASE WHEN bool_and(label IN ('purchase', 'error')) THEN true WHEN NOT bool_or(label IN ('purchase', 'error')) THEN false END AS contact, CAST(count(DISTINCT label) AS BIGINT) AS n_labels FROM w GROUP BY user_id, win
""")
def interval_overlap_flags(spark, sf_dir):
    """Windows of a day: true, false or (mixed) NULL for contact."""
    segs = _segments(spark, sf_dir)
    windows = segs.select("user_id", F.explode(F.sequence(F.floor(F.col("t0") / DAY), F.floor((F.col("t1") - 1) / DAY))).alias("win")).distinct()
    windows = windows.select("user_id", (F.col("win") * DAY).alias("t0"), ((F.col("win") + 1) * DAY).alias("t1"), F.col("win").cast("string").alias("label"))
    pairs = J.overlap_join(windows, segs, ["user_id"], DAY)
    on = F.col("b_label").isin("purchase", "error")
    return pairs.groupBy("user_id", F.col("a_label").cast("bigint").alias("win")).agg(
        F.when(F.bool_and(on), True).when(~F.bool_or(on), False).alias("contact"), F.count_distinct("b_label").alias("n_labels"))


_PROBE = "(SELECT user_id, unnest(range(0, 30)) AS probe_id FROM (SELECT DISTINCT user_id FROM events))"


@query(f"""
    WITH p AS (SELECT user_id, probe_id, 1704067200000 + probe_id * {DAY} AS t FROM {_PROBE}),
    e AS (SELECT user_id, t, max(event_type) AS event_type FROM {EV} GROUP BY user_id, t)
    SELECT p.user_id, CAST(p.probe_id AS BIGINT) AS probe_id, p.t, coalesce(e.event_type, 'idle') AS event_type FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.t >= e.t
""")
def asof_label(spark, sf_dir):
    e = events(spark, sf_dir)
    probes = e.select("user_id").distinct().withColumn("probe_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint")))).select(
        "user_id", "probe_id", (F.lit(1704067200000) + F.col("probe_id") * DAY).alias("t"))
    return J.asof_join(probes, e, ["user_id"], "t", "event_type", "idle")


@query(f"""
    WITH p AS (SELECT user_id, probe_id, 1704067200000 + probe_id * {DAY} AS t FROM {_PROBE}),
    e AS (SELECT user_id, t, max(event_type) AS event_type FROM {EV} GROUP BY user_id, t),
    g AS (SELECT p.user_id, p.probe_id, coalesce(e.event_type, 'idle') AS gt FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.t >= e.t),
    q AS (SELECT p.user_id, p.probe_id, coalesce(e.event_type, 'idle') AS pr FROM p ASOF LEFT JOIN (SELECT user_id, t + 7200000 AS t, event_type FROM e) e ON p.user_id = e.user_id AND p.t >= e.t)
    SELECT gt, pr, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY gt), 6) AS share FROM g JOIN q USING (user_id, probe_id) GROUP BY gt, pr
""")
def frame_confusion(spark, sf_dir):
    e = events(spark, sf_dir)
    probes = e.select("user_id").distinct().withColumn("probe_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint")))).select("user_id", "probe_id", (F.lit(1704067200000) + F.col("probe_id") * DAY).alias("t"))
    gt = J.asof_join(probes, e, ["user_id"], "t", "event_type", "idle").withColumnRenamed("event_type", "gt")
    pr = J.asof_join(probes, e.withColumn("t", F.col("t") + 2 * HOUR), ["user_id"], "t", "event_type", "idle").withColumnRenamed("event_type", "pr")
    counts = gt.join(pr, ["user_id", "probe_id", "t"]).groupBy("gt", "pr").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gt")), 6))


@query("SELECT rec_no, k FROM fp_metadata, (SELECT DISTINCT lower(trim(activity)) AS k FROM fp_metadata WHERE activity IS NOT NULL) WHERE contains(lower(path_v), k)")
def join_substring(spark, sf_dir):
    meta = table(spark, sf_dir, "fp_metadata")
    needles = meta.select(F.lower(F.trim("activity")).alias("k")).where("k IS NOT NULL").distinct()
    return J.substring_join(meta.select("rec_no", F.lower("path_v").alias("path")), "path", needles, "k", 3).select("rec_no", "k")
