"""Scores of samples against one or several truths, and scores of windows and sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.operators.metrics import mean, stderr

#: Metrics of a task that names none, by the kind of its requests (fixed values).
DEFAULT_METRICS = {
    "loglikelihood": ["perplexity", "acc"], "multiple_choice": ["acc", "acc_norm"], "generate_until": ["exact_match"], "generate_until_multi_round": ["exact_match"],
}


def max_over(golds: Column, score: Callable[[Column], Column]) -> Column:
    """The best score against any of several truths; NULL without one."""
    return F.array_max(F.transform(golds, score))


def any_match(golds: Column, score: Callable[[Column], Column]) -> Column:
    """1.0 if any truth scores above zero, else 0.0."""
    return F.coalesce(F.exists(golds, lambda g: F.coalesce(score(g), F.lit(0.0)) > 0), F.lit(False)).cast("double")


def loglikelihood_scores(loglikelihood: Column, is_greedy: Column) -> list[Column]:
    """perplexity (the log likelihood itself, aggregated later) and acc (was the continuation the greedy one)."""
    return [loglikelihood.cast("double").alias("perplexity"), is_greedy.cast("double").alias("acc")]


def gold_positions(gold: Column, choices: Column) -> Column:
    """array<int> of the right choices' positions from a gold text: one of the
    choices, a number, or a list of numbers; what is out of range is -100, which
    no choice is."""
    listed = F.from_json(gold, "array<int>")
    one = gold.try_cast("int")
    by_text = F.array_position(choices, gold).cast("int") - 1
    found = F.when(by_text >= 0, F.array(by_text)).when(one.isNotNull(), F.array(one)).otherwise(listed)
    n = F.size(choices)
    return F.transform(F.coalesce(found, F.array(F.lit(-100))), lambda i: F.when((i >= 0) & (i < n), i).otherwise(-100))


def choice_accuracies(losses: Column, gold: Column, lengths: Column) -> list[Column]:
    """acc and acc_norm: whether the least loss, plain and by length, is at a right position (of ``gold_positions``)."""
    best = lambda x: F.array_position(x, F.array_min(x)).cast("int") - 1
    right = lambda x: F.array_contains(gold, best(x)).cast("double")
    return [right(losses).alias("acc"), right(F.zip_with(losses, lengths, lambda a, n: a / n)).alias("acc_norm")]


def all_right(df: DataFrame, keys: list[str], paragraph: str, question: str, right: str) -> DataFrame:
    """(keys, acc_all, stderr): the share of (paragraph, question) whose answers are
    all right; its error goes by the question alone, over all its paragraphs."""
    one = F.min(F.coalesce(F.col(right).cast("int"), F.lit(0)))
    pairs = df.groupBy(*keys, question, paragraph).agg(one.alias("_a"))
    questions = pairs.groupBy(*keys, question).agg(F.min("_a").alias("_q"), F.sum("_a").alias("_s"), F.count("*").alias("_n"))
    return questions.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("acc_all"), stderr(F.col("_q")).alias("stderr"))


def combined_stderr(parts: Column) -> Column:
    """The error of several parts taken together one after the other, by their
    means too; ``parts`` is array<struct<se, n, value>> in order. Of one part its
    own; NULL of none."""
    first = F.get(parts, 0)
    start = F.struct((first["se"] * first["se"]).alias("v"), first["n"].cast("double").alias("n"), first["value"].cast("double").alias("m"))

    def join(a: Column, p: Column) -> Column:
        n = a["n"] + p["n"]
        m = (a["m"] * a["n"] + p["value"] * p["n"]) / n
        v = ((a["n"] - 1) * a["v"] + (p["n"] - 1) * p["se"] * p["se"]) / (n - 1) + a["n"] * p["n"] / (n * (n - 1)) * (m - p["value"]) * (m - p["value"])
        return F.struct(v.alias("v"), n.cast("double").alias("n"), m.cast("double").alias("m"))

    return F.when(F.size(parts) > 0, F.sqrt(F.aggregate(F.slice(parts, 2, 1_000_000_000), start, join, lambda a: a["v"])))


def weighted_by(value: Column, weight: Column) -> Column:
    """Aggregate: the mean of values by their weights, rows without either left out."""
    both = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def n_track_items(track: Column) -> Column:
    """Items of a ``label@t;...`` text."""
    return F.size(F.filter(F.split(track, ";"), lambda x: F.contains(x, F.lit("@"))))


def count_ratio(pred: Column, target: Column) -> Column:
    """Items of the predicted track over those of the target; NULL where that has none."""
    return F.when(n_track_items(target) > 0, n_track_items(pred) / n_track_items(target))


def section_errors(df: DataFrame, section: str, gold: str, pred: str) -> DataFrame:
    """(section, avg_error, std_error, n) of absolute errors; sections of one row are
    left out, and the error is over all rows of a section, with those that have no error."""
    off = F.abs(F.col(gold) - F.col(pred))
    off = F.when(~F.isnan(off.cast("double")), off)
    out = df.groupBy(section).agg(mean(off).alias("avg_error"), (F.stddev_samp(off) / F.sqrt(F.count("*"))).alias("std_error"), F.count("*").alias("n"))
    return out.where("n >= 2")


def cohort_errors(df: DataFrame, cohort: str, key: str, pred: str, true: str) -> DataFrame:
    """(cohort, mean_rce, sem_rce, n): relative counting error per ``key`` (summed
    absolute errors over summed true counts), then its mean and error per cohort."""
    per = df.groupBy(cohort, key).agg(F.try_divide(F.sum(F.abs(F.col(pred) - F.col(true))), F.sum(true)).alias("_rce"))
    return per.groupBy(cohort).agg(mean(F.col("_rce")).alias("mean_rce"), stderr(F.col("_rce")).alias("sem_rce"), F.count("_rce").alias("n"))


def window_accuracy(windows: DataFrame, segs: DataFrame, keys: list[str], flag: str, pred: str) -> DataFrame:
    """(keys, window_id, oracle, model): the share of a window's time in which the
    segments' flag equals that at the window's middle, and the window's prediction.

    ``windows`` has keys, window_id, t0, t1 and the prediction (NULL: no model
    share); ``segs`` keys, t0, t1 and the flag. A window without a segment is
    left out; with none at its middle it has no oracle share.
    """
    s = segs.select(*keys, F.col("t0").alias("_a"), F.col("t1").alias("_b"), F.col(flag).alias("_f"))
    both = windows.select(*keys, "window_id", "t0", "t1", F.col(pred).alias("_p")).join(s, keys).where("_a < t1 AND t0 < _b")
    part = F.least("t1", "_b") - F.greatest("t0", "_a")
    middle = (F.col("t0") + F.col("t1")) / 2.0
    w = Window.partitionBy(*keys, "window_id")
    rows = both.withColumn("_d", part).withColumn("_mid", F.max(F.when((F.col("_a") <= middle) & (middle < F.col("_b")), F.col("_f"))).over(w))
    return rows.groupBy(*keys, "window_id").agg(
        F.try_divide(F.sum(F.when(F.col("_mid").isNotNull(), F.when(F.col("_f") == F.col("_mid"), F.col("_d")).otherwise(0))), F.sum(F.when(F.col("_mid").isNotNull(), F.col("_d")))).alias("oracle"),
        F.try_divide(F.sum(F.when(F.col("_p").isNotNull(), F.when(F.col("_f") == F.col("_p"), F.col("_d")).otherwise(0))), F.sum(F.when(F.col("_p").isNotNull(), F.col("_d")))).alias("model"))


def largest_box(text: Column) -> Column:
    """struct<box, label> of the largest box in a detector's answer: the JSON array
    between the first ``[`` and the last ``]``; boxes as ``bbox_2d``, else
    ``bbox``, the first of equal ones. NULL where there is no box."""
    array = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    found = F.from_json(array, "array<struct<bbox_2d: array<double>, bbox: array<double>, label: string>>")
    boxes = F.filter(F.transform(found, lambda d: F.struct(F.coalesce(d["bbox_2d"], d["bbox"]).alias("box"), d["label"].alias("label"))), lambda d: F.size(d["box"]) >= 4)
    zero = F.lit(0.0)
    area = lambda b: F.greatest(F.get(b, 2) - F.get(b, 0), zero) * F.greatest(F.get(b, 3) - F.get(b, 1), zero)
    areas = F.transform(boxes, lambda d: area(d["box"]))
    return F.get(boxes, F.array_position(areas, F.array_max(areas)).cast("int") - 1)
