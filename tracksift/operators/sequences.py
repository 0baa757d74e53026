"""Label sequences: collapse, code, segment, repair, chunk and compare them.

Everything is keyed by one entity column and ordered by (time, tie-breaker), so
operators chained on one key share a single shuffle and sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def collapse(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Rows whose label differs from the row before (the first row always);
    NULL labels count as one label."""
    w = ordered(keys, order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_keep", first | ~F.lag(label).over(w).eqNullSafe(F.col(label))).where("_keep").drop("_keep")


def coded(labels: Column, alphabet: list[str]) -> Column:
    """One character per label, so the built-in edit distance counts labels;
    labels outside the alphabet share ``~``."""
    code = F.create_map(*[F.lit(x) for i, l in enumerate(alphabet) for x in (l, chr(ord("A") + i))])
    return F.array_join(F.transform(labels, lambda x: F.coalesce(F.try_element_at(code, x), F.lit("~"))), "")


def edit_scores(df: DataFrame, pred: str, ref: str, alphabet: list[str]) -> DataFrame:
    """``df`` with n_pred, n_ref, distance, edit_score (0 to 100, 100 if both are
    empty), action_error_rate (0 for an empty reference) and rce (relative
    counting error) of two label arrays, both without adjacent repeats.

    Labels become characters once; repeats are then dropped, counted and
    compared on the strings.
    """
    one = lambda c: F.regexp_replace(coded(F.col(c), alphabet), r"(.)\1+", "$1")
    rows = df.withColumn("_p", one(pred)).withColumn("_r", one(ref))
    rows = rows.withColumn("n_pred", F.length("_p").cast("bigint")).withColumn("n_ref", F.length("_r").cast("bigint")).withColumn("_d", F.levenshtein("_p", "_r").cast("bigint"))
    count = lambda c, i: F.length(c) - F.length(F.translate(F.col(c), chr(ord("A") + i), ""))
    off = sum((F.abs(count("_p", i) - count("_r", i)) for i in range(len(alphabet))), F.lit(0))
    longest = F.greatest("n_pred", "n_ref")
    return (rows.withColumn("edit_score", F.when(longest == 0, 100.0).otherwise((1.0 - F.col("_d") / longest) * 100.0))
            .withColumn("action_error_rate", F.when(F.col("n_ref") == 0, 0.0).otherwise(F.col("_d") / F.col("n_ref")))
            .withColumn("rce", F.when(F.col("n_ref") == 0, 0.0).otherwise(off / F.col("n_ref"))).withColumn("distance", F.col("_d")).drop("_p", "_r", "_d"))


def encode_track(labels: Column, times: Column) -> Column:
    """``label@t;...`` with three decimals; the last label is repeated at the end time."""
    closed = F.concat(labels, F.slice(labels, -1, 1))
    return F.array_join(F.zip_with(closed, times, lambda a, t: F.format_string("%s@%.3f", a, t)), ";")


def decode_track(text: Column) -> Column:
    """struct<labels, times> of an encoded track; the closing label is dropped if there are two or more."""
    tokens = F.filter(F.split(text, ";"), lambda x: F.contains(x, F.lit("@")))
    labels = F.transform(tokens, lambda x: F.trim(F.substring_index(x, "@", 1)))
    times = F.transform(tokens, lambda x: F.substring_index(x, "@", -1).try_cast("double"))
    return F.struct(F.when(F.size(labels) > 1, F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels).alias("labels"), times.alias("times"))


def segments(df: DataFrame, keys: list[str], order: list[str], at: str, label: str, end: Column | None = None) -> DataFrame:
    """Half-open segments (keys, label, t0, t1) between label changes; the last
    one ends at the entity's last time, or at ``end`` where given, to which all
    are clipped. Segments of no length are dropped."""
    w = ordered(keys, order)
    whole = Window.partitionBy(*keys)
    limit = end if end is not None else F.max(at).over(whole)
    rows = df.withColumn("_end", limit).withColumn("_keep", (F.row_number().over(w) == 1) | ~F.lag(label).over(w).eqNullSafe(F.col(label))).where("_keep")
    out = rows.select(*keys, F.col(label).alias("label"), F.col(at).alias("t0"), F.least(F.lead(at).over(w), F.col("_end")).alias("_next"), "_end")
    return out.withColumn("t1", F.coalesce("_next", "_end")).where("t1 > t0").drop("_next", "_end")


def merge_touching(df: DataFrame, keys: list[str], tolerance: int = 0) -> DataFrame:
    """Segments of equal label that touch (within ``tolerance``) made one; ``df`` has label, t0, t1."""
    w = ordered(keys, ["t0", "t1", "label"])
    new = F.when(F.lag("label").over(w).eqNullSafe(F.col("label")) & (F.lag("t1").over(w) + tolerance >= F.col("t0")), 0).otherwise(1)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (df.withColumn("_new", new).withColumn("_i", island).groupBy(*keys, "_i")
            .agg(F.first("label").alias("label"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count("*").alias("n_parts")).drop("_i"))


def lookahead_labels(df: DataFrame, keys: list[str], at_ms: str, motion: Column, contact: Column, window_ms: int) -> DataFrame:
    """``df`` with ``label`` from two flags: motion without contact is a reach if
    a row up to ``window_ms`` later (inclusive) has contact, else a reposition."""
    rows = df.withColumn("_m", motion).withColumn("_c", contact.cast("int"))
    ahead = F.max("_c").over(Window.partitionBy(*keys).orderBy(at_ms).rangeBetween(0, window_ms))
    label = (F.when(F.col("_m") & (F.col("_c") == 1), "transport").when(F.col("_m"), F.when(ahead == 1, "reach").otherwise("reposition"))
             .when(F.col("_c") == 1, "stabilize").otherwise("idle"))
    return rows.withColumn("label", label).drop("_m", "_c")


def backward_repair(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """A reach that no transport or stabilize follows before the next idle (or the end) becomes a reposition."""
    w = ordered(keys, order).rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col(label).isin("transport", "stabilize", "idle"), F.col(label))
    nxt = F.first(known, ignorenulls=True).over(w)
    lost = (F.col(label) == "reach") & (nxt.isNull() | (nxt == "idle"))
    return df.withColumn("repaired", F.when(lost, "reposition").otherwise(F.col(label)))


def unknown_runs(df: DataFrame, keys: list[str], order: list[str], label: str, unknown: str = "UNK") -> DataFrame:
    """Unknown runs named by the known labels around them (``repaired``): between
    two idles reach then reposition, between two transports the reverse, each
    half of the run; before a transport reach; with nothing around idle; else
    reposition."""
    w = ordered(keys, order)
    is_unknown = F.col(label) == unknown
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("_known", F.when(~is_unknown, F.col(label)))
    rows = rows.withColumn("_left", F.last("_known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_right", F.first("_known", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.withColumn("_a", F.max(F.when(~is_unknown, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_b", F.min(F.when(~is_unknown, F.col("_n"))).over(w.rowsBetween(0, Window.unboundedFollowing)))
    start = F.coalesce("_a", F.lit(0)) + 1
    last = F.coalesce(F.col("_b") - 1, F.count("*").over(Window.partitionBy(*keys)))
    early = F.col("_n") <= F.floor((start + last) / 2)
    named = (F.when(F.col("_left").isNull() & F.col("_right").isNull(), "idle")
             .when((F.col("_left") == "idle") & (F.col("_right") == "idle"), F.when(early, "reach").otherwise("reposition"))
             .when((F.col("_left") == "transport") & (F.col("_right") == "transport"), F.when(early, "reposition").otherwise("reach"))
             .when(F.col("_right") == "transport", "reach").otherwise("reposition"))
    return rows.withColumn("repaired", F.when(is_unknown, named).otherwise(F.col(label))).drop("_n", "_known", "_left", "_right", "_a", "_b")


def gap_fill(df: DataFrame, keys: list[str], order: list[str], at: str, label: str) -> DataFrame:
    """``df`` (keys, at, label) with one row put into each gap, and ``filled``.

    Steps to the next row are counted per entity; the two most frequent are
    legal, any other is a gap. The new row comes one most frequent step later
    and keeps the label if both neighbours have it, else ''.
    """
    w = ordered(keys, order)
    rows = df.withColumn("_step", F.lead(at).over(w) - F.col(at)).withColumn("_next", F.lead(label).over(w))
    counts = rows.where("_step IS NOT NULL").groupBy(*keys, "_step").agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_step"))
    legal = counts.withColumn("_r", rank).groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col("_step"))).alias("_s1"), F.max(F.when(F.col("_r") == 2, F.col("_step"))).alias("_s2"))
    gaps = rows.join(legal, keys).where("_step <> _s1 AND (_s2 IS NULL OR _step <> _s2)")
    new = gaps.select(*keys, (F.col(at) + F.col("_s1")).alias(at), F.when(F.col(label).eqNullSafe(F.col("_next")), F.col(label)).otherwise("").alias(label), F.lit(True).alias("filled"))
    return df.select(*keys, at, label, F.lit(False).alias("filled")).unionByName(new)


def transitions(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """(from_label, to_label, n, share): label pairs of successive rows, shares within from_label."""
    w = ordered(keys, order)
    pairs = df.select(F.col(label).alias("from_label"), F.lead(label).over(w).alias("to_label")).where("to_label IS NOT NULL")
    counts = pairs.groupBy("from_label", "to_label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_label")))


def chunk_labels(segs: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, chunk, label): one label per window of ``width``: of the segments
    that overlap it, the lower median by the middle of the overlap. Segments are
    spread over their windows, so only windows with segments come out."""
    span = segs.where("t1 > t0").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor((F.col("t1") - 1) / width))))
    lo = F.greatest(F.col("t0"), F.col("chunk") * width)
    hi = F.least(F.col("t1"), (F.col("chunk") + 1) * width)
    w = Window.partitionBy(*keys, "chunk")
    rows = span.withColumn("_mid", lo + hi)
    rows = rows.withColumn("_r", F.row_number().over(w.orderBy("_mid", "t0", "label"))).withColumn("_n", F.count("*").over(w))
    return rows.where("_r = floor((_n - 1) / 2) + 1").select(*keys, "chunk", "label")


def hand_of(text: Column, left: str, right: str) -> tuple[Column, Column]:
    """Counts of left and right marks in a name (prefix and infix)."""
    low = F.lower(text)
    hits = lambda h: (F.when(low.startswith(f"{h}_"), 1).otherwise(0) + F.when(low.contains(f"_{h}_"), 1).otherwise(0))
    return hits(left), hits(right)


def marker_label(text: Column) -> Column:
    """The label of a marker name by keyword, the first of reach, reposition or
    retract, transport, stabilize, idle or rest; NULL if it has none."""
    low = F.lower(text)
    has = lambda *ws: [low.contains(x) for x in ws]
    a, b = has("reposition", "retract")
    c, d = has("idle", "rest")
    return (F.when(low.contains("reach"), "reach").when(a | b, "reposition").when(low.contains("transport"), "transport")
            .when(low.contains("stabilize"), "stabilize").when(c | d, "idle"))


def free_text_labels(df: DataFrame, keys: list[str], text: str, t0: str, t1: str, labels: list[str]) -> DataFrame:
    """(keys, pos, label, at): the labels a text names, in order, spread evenly over [t0, t1)."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit("(" + "|".join(labels) + ")"), F.lit(1))
    rows = df.select(*keys, F.col(t0).alias("_a"), F.col(t1).alias("_b"), found.alias("_l"), F.size(found).alias("_n"))
    rows = rows.select(*keys, "_a", "_b", "_n", F.posexplode("_l").alias("pos", "label"))
    return rows.select(*keys, "pos", "label", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("pos") / F.col("_n")).alias("at"))


def clip_audit(df: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """(keys, n_clips, overlapping, left_open, stray_ends) of start (s) and end (e)
    marks: a start while one is open overlaps, an end while none is strays."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col(kind) == "s", 1).when(F.col(kind) == "e", -1).otherwise(0)
    rows = df.withColumn("_s", step).withColumn("_open", F.coalesce(F.sum("_s").over(w), F.lit(0)))
    starts = F.count_if(F.col(kind) == "s")
    return rows.groupBy(*keys).agg(
        starts.alias("n_clips"), F.count_if((F.col(kind) == "s") & (F.col("_open") > 0)).alias("overlapping"),
        F.greatest(F.sum("_s"), F.lit(0)).alias("left_open"), F.count_if((F.col(kind) == "e") & (F.col("_open") <= 0)).alias("stray_ends"))


def simulate(shares: DataFrame, start: str, n_sequences: int, length: int, seed: int) -> DataFrame:
    """(sequence, pos, label): Markov chains of a transition table (from_label, to_label,
    share), one seeded generator per sequence, so partitioning doesn't matter. The
    table has a row per pair of labels and rides along with the generator."""
    table: dict[str, tuple[list[str], list[float]]] = {}
    for a, b, p in shares.select("from_label", "to_label", "share").orderBy("from_label", "to_label").collect():  # few: pairs of labels
        names, weights = table.setdefault(a, ([], []))
        names.append(b)
        weights.append(p)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (k,) in rows:
            rng, label = np.random.default_rng([seed, k]), start
            for pos in range(length):
                yield k, pos, label
                names, weights = table.get(label, ([start], [1.0]))
                total = np.cumsum(weights)
                label = names[min(int(np.searchsorted(total, rng.random() * total[-1], side="right")), len(names) - 1)]

    schema = T.StructType([T.StructField("sequence", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("label", T.StringType())])
    return map_partition(shares.sparkSession.range(n_sequences), run, schema)


def marker_intervals(df: DataFrame, keys: list[str], order: list[str], at: str, text: str) -> DataFrame:
    """(keys, label, t0, duration) of markers by their keywords as they are written
    (lower case), successive equal ones as one; the last lasts to the entity's last
    time. Markers without a keyword are passed over."""
    value = F.col(text)
    has = lambda *ws: reduce(lambda a, b: a | b, [value.contains(x) for x in ws])
    label = (F.when(has("reach"), "reach").when(has("reposition", "retract"), "reposition").when(has("transport"), "transport")
             .when(has("stabilize"), "stabilize").when(has("idle", "rest"), "idle"))
    last = F.max(at).over(Window.partitionBy(*keys))
    rows = df.withColumn("_last", last).withColumn("label", label).where("label IS NOT NULL")
    kept = collapse(rows, keys, order, "label")
    end = F.coalesce(F.lead(at).over(ordered(keys, order)), F.col("_last"))
    return kept.select(*keys, "label", F.col(at).alias("t0"), (end - F.col(at)).alias("duration"))


def window_flags(windows: DataFrame, segs: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """(keys, window_id, middle, whole, labels): the segments' flag at a window's
    middle, the flag of the whole window (NULL if it changes) and its different
    labels in order of their first time; ``segs`` has t0, t1, label and the flag.
    Windows without a segment have NULLs and no labels."""
    s = segs.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.col("t0").alias("_a"), F.col("t1").alias("_b"), F.col("label").alias("_l"), F.col(flag).alias("_f"))
    on = (F.col("_a") < F.col("t1")) & (F.col("t0") < F.col("_b"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_s{i}"))
    rows = windows.join(s, on, "left")
    middle = (F.col("t0") + F.col("t1")) / 2.0
    firsts = rows.groupBy(*keys, "window_id", "_l").agg(F.min("_a").alias("_first"), F.max(F.when((F.col("_a") <= middle) & (middle < F.col("_b")), F.col("_f"))).alias("_mid"), F.min("_f").alias("_low"), F.max("_f").alias("_high"))
    items = F.array_sort(F.collect_list(F.when(F.col("_l").isNotNull(), F.struct("_first", "_l"))))
    return firsts.groupBy(*keys, "window_id").agg(
        F.max("_mid").alias("middle"), F.when(F.min("_low") == F.max("_high"), F.min("_low")).alias("whole"), F.transform(items, lambda x: x["_l"]).alias("labels"))


def count_errors(pred: Column, ref: Column, labels: list[str]) -> Column:
    """struct<errors map<label, n>, mean, n_pred, n_ref>: how far a label's counts in two
    sequences are apart, per label and on average."""
    count = lambda seq, l: F.size(F.filter(seq, lambda x: x == l))
    off = [F.abs(count(pred, l) - count(ref, l)) for l in labels]
    return F.struct(F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*off)).alias("errors"), (sum(off[1:], off[0]) / len(labels)).alias("mean"),
                    F.size(pred).alias("n_pred"), F.size(ref).alias("n_ref"))


def class_durations(sides: dict[str, DataFrame]) -> DataFrame:
    """(side, label, n, total, mean): segments' durations per label of each named side (label, t0, t1)."""
    span = F.col("t1") - F.col("t0")
    parts = [df.select(F.lit(name).alias("side"), "label", span.alias("_d")) for name, df in sides.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("side", "label").agg(F.count("*").alias("n"), F.sum("_d").alias("total"), (F.sum("_d") / F.count("_d")).alias("mean"))
