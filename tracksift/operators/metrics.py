"""Metrics: per row as Columns, and aggregates as a registry.

``AGGREGATIONS`` maps a name to a builder of an aggregate Column, so a task's
metrics are one ``agg`` with partial aggregation before the shuffle;
``STANDARD_ERRORS`` says how each gets its standard error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.operators.bootstrap import ROUNDS, bootstrap
from tracksift.operators.ranks import RANGE, ranged, running_total
from tracksift.functions.arrow import map_partition
from tracksift.session import discard, materialize, shuffle_parts

AGGREGATIONS: dict[str, Callable[..., Column]] = {}


def register_aggregation(name: str):
    def add(f: Callable[..., Column]):
        if name in AGGREGATIONS:
            raise ValueError(f"aggregation {name} is registered already")
        AGGREGATIONS[name] = f
        return f

    return add


def total(v: Column) -> Column:
    """Aggregate: the sum, the same in whatever order the rows come: values are
    added as decimals of twelve places. Where a value is too large or too small
    for that, or not finite, it is the sum of doubles."""
    d = v.cast("double")
    exact = d.try_cast("decimal(28,12)")
    fits = F.count_if(exact.isNotNull() & ((d == 0) | (F.abs(d) >= 1e-6))) == F.count(d)
    return F.when(fits, F.sum(exact).cast("double")).otherwise(F.sum(d))


@register_aggregation("mean")
def mean(v: Column) -> Column:
    """The mean over the rows with a value, the same in whatever order they come:
    their ``total`` is divided once."""
    return F.try_divide(total(v), F.count(v))


@register_aggregation("median")
def median(v: Column) -> Column:
    """The exact median of a task's scores. Its state grows with the different
    values of a group; for large groups of many values see ``exact_quantiles``."""
    return F.percentile(v, 0.5)


@register_aggregation("bypass")
def bypass(v: Column) -> Column:
    return F.max(F.lit(999.0))


@register_aggregation("perplexity")
def perplexity(v: Column) -> Column:
    return F.exp(-F.avg(v))


@register_aggregation("weighted_mean")
def weighted_mean(v: Column, weight: Column) -> Column:
    return F.sum(v) / F.sum(weight)


@register_aggregation("weighted_perplexity")
def weighted_perplexity(v: Column, weight: Column) -> Column:
    return F.exp(-weighted_mean(v, weight))


@register_aggregation("bits_per_byte")
def bits_per_byte(v: Column, weight: Column) -> Column:
    return -weighted_mean(v, weight) / math.log(2)


@register_aggregation("f1")
def f1(gold: Column, pred: Column) -> Column:
    tp = F.count_if(gold & pred)
    return F.coalesce(F.try_divide(2.0 * tp, F.count_if(gold) + F.count_if(pred)), F.lit(0.0))


@register_aggregation("matthews")
def matthews(gold: Column, pred: Column) -> Column:
    tp, tn = F.count_if(gold & pred).cast("double"), F.count_if(~gold & ~pred).cast("double")
    fp, fn = F.count_if(~gold & pred).cast("double"), F.count_if(gold & ~pred).cast("double")
    return F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))


def matthews_multiclass(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, mcc) of any number of classes from a confusion table (keys, gold, pred, n); 0 where undefined."""
    keys = keys or []
    sides = cells.select(*keys, F.inline(F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("hit")))))
    per = sides.groupBy(*keys, "label").agg(*[F.sum(c).cast("double").alias(c) for c in ("g", "p", "hit")])
    s, c = F.sum("g"), F.sum("hit")
    both, gg, pp = F.sum(F.col("g") * F.col("p")), F.sum(F.col("g") * F.col("g")), F.sum(F.col("p") * F.col("p"))
    return per.groupBy(*keys).agg(F.coalesce(F.try_divide(c * s - both, F.sqrt((s * s - pp) * (s * s - gg))), F.lit(0.0)).alias("mcc"))


@register_aggregation("acc_all")
def acc_all(v: Column) -> Column:
    """The mean of whether all of a question's answers are right, given one value per question."""
    return mean(v)


def stddev(v: Column, population: bool = False) -> Column:
    """Standard deviation over the rows with a value, of a sample or of the whole."""
    return F.stddev_pop(v) if population else F.stddev_samp(v)


@register_aggregation("stderr")
def stderr(v: Column) -> Column:
    """Standard error of the mean over the rows with a value."""
    return F.stddev_samp(v) / F.sqrt(F.count(v))


#: closed: of the mean; bootstrap: by resampling; others have none.
STANDARD_ERRORS = {"mean": "closed", "acc_all": "closed", "median": "bootstrap", "matthews": "bootstrap", "f1": "bootstrap", "perplexity": "bootstrap",
                   "bleu": "bootstrap", "chrf": "bootstrap", "ter": "bootstrap"}


def bootstrap_stderr(df: DataFrame, keys: list[str], value: str, row_id: str, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """(keys, stderr) of the mean by ``bootstrap``. Rows are counted by value, so
    ``row_id`` makes no difference."""
    return bootstrap(df, keys, [value], "mean", rounds, seed)


def pooled_stderr(se: Column, n: Column) -> Column:
    """Aggregate: the standard error of tasks pooled by their sizes."""
    total = F.sum(n)
    return F.sqrt(F.sum((n - 1) * se * se * n) / (total - F.count(n)) / total)




def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles, interpolated between neighbours.

    Equal values are counted before anything is sorted, positions come from
    running totals over ranges of values, so neither a hot group nor one of very
    many values is held in one task. NULL and NaN values are left out, and
    groups without others.
    """
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_c"))
    counts = ranged(known, [*keys, "_v"])
    upto = running_total(counts, keys, F.col(RANGE), ["_v"], F.col("_c"), "_cum")
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    cols = []
    for i, q in enumerate(shares):
        h = (F.col("_n") - 1) * F.lit(float(q))
        at = lambda p: F.min(F.when(F.col("_cum") > p, F.col("_v")))
        low, high = at(F.floor(h)), at(F.ceil(h))
        cols.append((low + (high - low) * F.max(h - F.floor(h))).alias(f"q{i}"))
    return upto.join(totals, keys).groupBy(*keys).agg(*cols)


def arrival_median(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, mid): the middle value in order of arrival (a unique number), not of size."""
    rows = ranged(df.select(*keys, order, value), [*keys, order])
    placed = running_total(rows, keys, F.col(RANGE), [order], F.lit(1), "_i")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return placed.join(sizes, keys).where("_i = floor(_n / 2) + 1").select(*keys, F.col(value).alias("mid"))


def sequence_hash(df: DataFrame, keys: list[str], order: list[str], digest: str) -> DataFrame:
    """(keys, hash): SHA-256 over a group's digests one after the other in ``order``.

    A group's rows are sorted, not gathered: they are hashed as they stream by,
    so a group of any size takes no more memory than its digest. NULL digests
    add nothing; a group with no other has the hash of nothing.
    """
    rows = df.select(*keys, *order, F.col(digest).cast("string").alias("_d"))
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("hash", T.StringType())])
    n = len(keys)

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        who, state = None, None
        for r in stream:
            if state is None or r[:n] != who:
                if state is not None:
                    yield *who, state.hexdigest()
                who, state = r[:n], hashlib.sha256()
            if r[-1] is not None:
                state.update(r[-1].encode())
        if state is not None:
            yield *who, state.hexdigest()

    parted = rows.repartition(shuffle_parts(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return map_partition(parted, run, schema)


# --- per row ---------------------------------------------------------------


def exact_match(a: Column, b: Column, ignore: list[str] | None = None, case: bool = True, punctuation: bool = True, digits: bool = True) -> Column:
    """1.0 or 0.0, after the patterns, and where asked case, punctuation or digits, are left out."""

    def clean(x: Column) -> Column:
        for pattern in ignore or []:
            x = F.regexp_replace(x, pattern, "")
        x = x if case else F.lower(x)
        x = x if punctuation else F.regexp_replace(x, r"[\p{Punct}]", "")
        return x if digits else F.regexp_replace(x, "[0-9]", "")

    return (clean(a) == clean(b)).cast("double")


def anls(pred: Column, golds: Column, threshold: float = 0.5) -> Column:
    """Best normalised edit similarity to a gold, 0 below the threshold. Texts are
    compared without case and with each run of blanks as one; the length they are
    measured by is that of the texts as they are."""
    plain = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    sim = F.array_max(F.transform(golds, lambda g: 1.0 - F.levenshtein(plain(pred), plain(g)) / F.greatest(F.length(pred), F.length(g), F.lit(1))))
    return F.when(sim < threshold, 0.0).otherwise(sim)


def choice_accuracy(losses: Column, gold: Column, lengths: Column | None = None) -> Column:
    """1.0 if the smallest loss (by length, where given) is the gold's; a gold out of range is -100, never right."""
    x = losses if lengths is None else F.zip_with(losses, lengths, lambda a, n: a / n)
    known = F.when((gold >= 0) & (gold < F.size(losses)), gold).otherwise(-100)
    return (F.array_position(x, F.array_min(x)) - 1 == known).cast("double")


def mutual_information_accuracy(conditional: Column, unconditional: Column, gold: Column) -> Column:
    gain = F.zip_with(conditional, unconditional, lambda a, b: a - b)
    return (F.array_position(gain, F.array_max(gain)) - 1 == gold).cast("double")


def brier(probabilities: Column, gold: Column) -> Column:
    """Summed squared distance to the gold's one-hot vector."""
    return F.aggregate(F.transform(probabilities, lambda p, i: F.pow(p - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) over their union; 0 for boxes without area."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def turned_box(b: list[Column]) -> list[Column]:
    """A box whose corners may be given in either order, as (left, top, right, bottom)."""
    return [F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])]


# --- tables ----------------------------------------------------------------


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(gold, pred, n, share): counts, and shares within gold."""
    counts = df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gold")))


def report(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from a confusion table; 0 where undefined."""
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = sides.groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("_p"), F.sum("tp").alias("_tp"))
    return sums.select("label", zero(F.try_divide("_tp", "_p")).alias("precision"), zero(F.try_divide("_tp", "support")).alias("recall"),
                       zero(F.try_divide(2.0 * F.col("_tp"), F.col("_p") + F.col("support"))).alias("f1"), "support")


def report_averages(rows: DataFrame) -> DataFrame:
    """The rows of ``report`` with their plain mean (``macro avg``) and the one by support (``weighted avg``)."""
    cols = ("precision", "recall", "f1")
    n = F.sum("support")
    macro = rows.agg(*[F.avg(c).alias(c) for c in cols], n.alias("support")).select(F.lit("macro avg").alias("label"), *cols, "support")
    weighted = rows.agg(*[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), n), F.lit(0.0)).alias(c) for c in cols], n.alias("support")).select(F.lit("weighted avg").alias("label"), *cols, "support")
    return rows.unionByName(macro).unionByName(weighted)


def rollup_groups(scores: DataFrame, edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(group, metric, value, stderr, n): scores (node, metric, value, stderr, n) of
    leaves rolled up over a tree of (parent, node) edges, by closure: a leaf
    counts once in each ancestor. The closure doubles its reach per round until
    nothing new is found, so any depth takes its logarithm in rounds, and a
    circle of groups ends. Edge tables are task trees, small beside the scores.
    Values are added by ``total``, so one that lies midway between two rounded ones
    doesn't depend on the order of the leaves."""
    closure = materialize(edges.select(F.col("parent").alias("group"), "node").where("group IS NOT NULL AND node IS NOT NULL").distinct(), "closure")
    n = closure.count()
    while n:
        up = closure.select(F.col("node").alias("_mid"), F.col("group").alias("_top"))
        longer = closure.join(up, F.col("group") == F.col("_mid")).select(F.col("_top").alias("group"), "node")
        more = materialize(closure.unionByName(longer).distinct(), "closure")
        discard(closure)
        closure, before, n = more, n, more.count()
        if n == before:
            break
    joined = scores.join(closure, "node")
    value = (total(F.col("value") * F.col("n")) / F.sum("n")) if weighted else mean(F.col("value"))
    return joined.groupBy("group", "metric").agg(value.alias("value"), pooled_stderr(F.col("stderr"), F.col("n")).alias("stderr"), F.sum("n").alias("n"))


def masked_f1(gold: Column, pred: Column) -> list[Column]:
    """f1 over rows with both, coverage, and bounds with the missing gold as right and as wrong."""
    both = gold.isNotNull() & pred.isNotNull()
    known = pred.isNotNull()
    return [
        f1(gold & both, pred & both).alias("f1"), (F.count_if(both) / F.count("*")).alias("coverage"),
        f1(F.coalesce(gold, pred) & known, pred & known).alias("f1_high"), f1(F.coalesce(gold, ~pred) & known, pred & known).alias("f1_low"),
    ]
