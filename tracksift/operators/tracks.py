"""From model answers to label tracks, and what tracks are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksift.operators.sequences import encode_track

# Labels that move, and that hold something.
MOVING, HOLDING = ("reach", "reposition", "transport"), ("transport", "stabilize")
LABELS = (*MOVING, "stabilize", "idle")


def full_segments(segments: Column) -> Column:
    """struct<tokens, times> of array<struct<text, t0, t1>>: texts as they are, their
    starts and the last end; both empty without segments."""
    return F.struct(F.transform(segments, lambda s: s["text"]).alias("tokens"),
                    F.concat(F.transform(segments, lambda s: s["t0"]), F.transform(F.slice(segments, -1, 1), lambda s: s["t1"])).alias("times"))


def two_answers(text: Column) -> Column:
    """struct<a, b> of ``A <SEP> B``, else of the first two yes or no in the text, in
    capitals; parts that aren't there are NULL."""
    parts = F.transform(F.split(text, "<SEP>"), lambda x: F.trim(x))
    said = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b(yes|no)\b"), F.lit(1)), lambda x: F.upper(x))
    pair = lambda x: F.struct(F.get(x, 0).alias("a"), F.get(x, 1).alias("b"))
    return F.when(F.size(parts) == 2, pair(parts)).otherwise(pair(said))


def label_flags(label: Column) -> Column:
    """struct<motion, grasp> of a label in any case; an unknown label is an error, NULL has NULL flags."""
    low = F.lower(F.trim(label))
    known = F.when(low.isin(*LABELS), low).when(low.isNotNull(), F.raise_error(F.concat(F.lit("unknown label "), low)).cast("string"))
    return F.struct(known.isin(*MOVING).alias("motion"), known.isin(*HOLDING).alias("grasp"))


def activity_tags(windows: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, window_id, tag) of windows (t0, t1): ``ACTIVE`` where only moving labels
    overlap, ``IDLE/STABILIZE`` where only idle does or nothing, else ``EITHER``."""
    s = segs.select(*keys, F.col("t0").alias("_a"), F.col("t1").alias("_b"), "label")
    same = [windows[k] == s[k] for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    rows = windows.join(s, on & (F.col("_a") < F.col("t1")) & (F.col("t0") < F.col("_b")), "left")
    n, moving, idle = F.count("label"), F.count_if(F.col("label").isin(*MOVING)), F.count_if(F.col("label") == "idle")
    tag = F.when(n == idle, "IDLE/STABILIZE").when(n == moving, "ACTIVE").otherwise("EITHER")
    return rows.groupBy(*[windows[k] for k in keys], "window_id").agg(tag.alias("tag"))


def free_text_track(segments: Column, labels: list[str]) -> Column:
    """struct<labels, times> of array<struct<text, t0, t1>>: the labels each text
    names, in order, spread evenly over its time, and the last segment's end."""
    words = F.lit("(" + "|".join(labels) + ")")

    def part(s: Column) -> Column:
        found = F.regexp_extract_all(F.lower(s["text"]), words, F.lit(1))
        n = F.size(found)
        return F.transform(found, lambda x, i: F.struct(x.alias("label"), (s["t0"] + (s["t1"] - s["t0"]) * i / n).alias("at")))

    items = F.flatten(F.transform(segments, part))
    return F.struct(F.transform(items, lambda x: x["label"]).alias("labels"),
                    F.concat(F.transform(items, lambda x: x["at"]), F.transform(F.slice(segments, -1, 1), lambda s: s["t1"])).alias("times"))


def flag_track(segments: Column, window_s: float) -> Column:
    """struct<labels, times> of segments answered ``motion <SEP> contact``: motion
    without contact is a reach where a later segment that starts up to
    ``window_s`` later has contact, else a reposition."""
    said = F.transform(segments, lambda s: F.struct(
        F.contains(F.lower(two_answers(s["text"])["a"]), F.lit("yes")).alias("m"), F.contains(F.lower(two_answers(s["text"])["b"]), F.lit("yes")).alias("c"), s["t0"].alias("t")))

    def named(x: Column, i: Column) -> Column:
        ahead = F.exists(said, lambda y: (y["t"] > x["t"]) & (y["t"] <= x["t"] + window_s) & y["c"])
        return (F.when(x["m"] & x["c"], "transport").when(x["m"], F.when(ahead, "reach").otherwise("reposition")).when(x["c"], "stabilize").otherwise("idle"))

    return F.struct(F.transform(said, named).alias("labels"), full_segments(segments)["times"].alias("times"))


def results_of_output(segments: Column, labels: list[str], window_s: float = 2.0) -> Column:
    """The ``label@t;...`` track of a response's segments. Each response is read in
    its own form: pairs of answers by ``flag_track``, else free text."""
    pairs = F.exists(segments, lambda s: F.contains(s["text"], F.lit("<SEP>")))
    text = lambda t: encode_track(t["labels"], t["times"])
    return F.when(pairs, text(flag_track(segments, window_s))).otherwise(text(free_text_track(segments, labels)))


def constant_track(label: str, t0: Column, t1: Column) -> Column:
    """The track of one label for the whole time."""
    return encode_track(F.array(F.lit(label)), F.array(t0.cast("double"), t1.cast("double")))


def omniscient_labels(chunks: DataFrame, keys: list[str], at: str, label: str, window: int) -> DataFrame:
    """``chunks`` with ``label`` made anew from its true flags by the look-ahead rule:
    the best that answers about flags alone can do."""
    from tracksift.operators.sequences import lookahead_labels

    flags = chunks.withColumn("_f", label_flags(F.col(label))).withColumn("_m0", F.col("_f")["motion"]).withColumn("_c0", F.col("_f")["grasp"]).drop(label, "_f")
    return lookahead_labels(flags, keys, at, F.col("_m0"), F.col("_c0"), window).drop("_m0", "_c0")


def pose_states(df: DataFrame, keys: list[str], order: list[str], status: str, rests: Column, picks_up: Column, releases: Column) -> DataFrame:
    """Rows (keys, *order, label) of a hand by its pose and the answers to questions
    that its state decides on.

    ``status`` is ``abstain`` (out of sight: idle and empty), ``fast`` (moving;
    what it holds stays), ``still`` or other. A hand at rest is idle; else an empty
    one reaches, a full one transports, or stabilizes while still.
    """
    from tracksift.operators.state import two_flag_states

    gone, fast = F.col(status) == "abstain", F.col(status) == "fast"
    asked = ~gone & ~fast
    rows = df.select(*keys, *order, F.coalesce(F.col(status), F.lit("")).alias(status), F.coalesce(rests, F.lit(False)).alias("_rests"),
                     F.coalesce(picks_up, F.lit(False)).alias("_picks"), F.coalesce(releases, F.lit(False)).alias("_drops"))
    held = two_flag_states(rows, keys, order, {"_holds": asked & F.col("_picks")}, {"_holds": gone | (asked & F.col("_drops"))})
    idle = gone | (asked & F.col("_rests"))
    label = F.when(idle, "idle").when(~F.col("_holds"), "reach").when(F.col(status) == "still", "stabilize").otherwise("transport")
    return rows.join(held, [*keys, *order]).select(*keys, *order, label.alias("label"))
