"""Groups: picking rows, shares, grids, audits, long and wide results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.operators.metrics import mean

#: Rows up to which a grid's dimension is broadcast; larger ones are left to Spark's own choice.
SMALL_DIMENSION = 10_000


def first_values(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """(keys, columns): per column the first value that isn't NULL, in ``order``."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return df.groupBy(*keys).agg(*map(first, columns))


def nth_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The ``n``-th row (from 0) of each group; groups with fewer have none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == n + 1).drop("_nth")


def preferred_rows(df: DataFrame, keys: list[str], preference: list[Column]) -> DataFrame:
    """One row per group, the one with the least ``preference`` (which should tell
    all rows apart): an aggregate, combined before the shuffle, not a sort."""
    key = F.struct(*[p.alias(f"_p{i}") for i, p in enumerate(preference)])
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(row, key).alias("_r")).select(*keys, "_r.*")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows of each group with their ``place``."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def cumulative_table(df: DataFrame, keys: list[str], value: str, limits: Sequence[float]) -> DataFrame:
    """(keys, limit_s, n, pct): how many values, and what share in percent, are at most each limit."""
    rows = df.where(F.col(value).isNotNull()).withColumn("limit_s", F.explode(F.array(*[F.lit(float(x)) for x in limits])))
    hit = F.count_if(F.col(value) <= F.col("limit_s"))
    return rows.groupBy(*keys, "limit_s").agg(hit.alias("n"), (100.0 * hit / F.count("*")).alias("pct"))


def described(df: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """(all keys, n, mean, sd, sem) over several grouping sets in one pass."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    v = F.col(value)
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.count("*").alias("n"), mean(v).alias("mean"), F.stddev_samp(v).alias("sd"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"))


def modes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mode, mode_n, share): the most frequent value, the smaller of equal ones, and its share."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col(value))).alias("mode"), F.max("_n").alias("mode_n"), (F.max("_n") / F.sum("_n")).alias("share"))


def grid(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Every pair of two dimensions' values, which is what a grid's result is made
    of; the second is broadcast where it is counted to be small."""
    few = columns.distinct()
    return rows.distinct().crossJoin(F.broadcast(few) if few.count() <= SMALL_DIMENSION else few)


def grid_filled(rows: DataFrame, columns: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """The grid with the values that are there, NULL where none is."""
    return grid(rows, columns).join(values, keys, "left")


def grid_accuracy(pred: Column, gold: Column) -> list[Column]:
    """accuracy, answered, cells: a missing prediction is no hit and counts all the same."""
    hit = F.sum(F.when(pred == gold, 1).otherwise(0))
    return [(hit / F.count("*")).alias("accuracy"), F.count(pred).alias("answered"), F.count("*").alias("cells")]


def subject_errors(df: DataFrame, subject: str, pred: str, gold: str, missing: int = 2) -> DataFrame:
    """(apd, mtsd) in one row: the mean over subjects of their summed absolute errors,
    a missing prediction counting ``missing``, and of the error of their sums, likewise."""
    p, g = F.col(pred), F.col(gold)
    per = df.groupBy(subject).agg(F.sum(F.coalesce(F.abs(p - g), F.lit(missing))).alias("_a"), (F.abs(F.coalesce(F.sum(p), F.lit(0)) - F.sum(g)) + missing * F.count_if(p.isNull())).alias("_m"))
    return per.agg(mean(F.col("_a")).alias("apd"), mean(F.col("_m")).alias("mtsd"))


def audit(rows: DataFrame, columns: DataFrame, marks: DataFrame, subject: list[str], item: list[str]) -> DataFrame:
    """(subject, missing, repeated, unknown): items of the grid that a subject lacks or
    has more than once, and its marks for items that aren't in the grid."""
    counts = marks.groupBy(*subject, *item).agg(F.count("*").alias("_n"))
    known = grid(rows, columns).withColumn("_known", F.lit(True))
    both = known.join(counts, [*subject, *item], "full")
    return both.groupBy(*subject).agg(F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if((F.col("_n") > 1) & F.col("_known").isNotNull()).alias("repeated"),
                                      F.count_if(F.col("_known").isNull()).alias("unknown"))


def majority_side(df: DataFrame, keys: list[str], left: Column, right: Column, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """(keys, n_left, n_right, arm): counts of two conditions and the more frequent one, the first of equal ones."""
    counts = df.groupBy(*keys).agg(F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"))
    return counts.withColumn("arm", F.when(F.col("n_right") > F.col("n_left"), names[1]).otherwise(names[0]))


def share_of_all(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, total, share): a group's sum over the sum of everything; one more
    aggregate over the few groups, not a window over rows."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("total").alias("_all")))).select(*keys, "total", F.try_divide("total", "_all").alias("share"))


def consensus(flag: Column) -> Column:
    """Aggregate: the flag's value where all rows have the same, else NULL."""
    return F.when(F.bool_and(flag) == F.bool_or(flag), F.bool_and(flag))


def sample_sizes(limit: int | None = None) -> list[Column]:
    """original and effective: the rows there are, and those a limit leaves."""
    n = F.count("*")
    return [n.alias("original"), (n if limit is None else F.least(n, F.lit(limit))).alias("effective")]


def batched(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """``df`` with ``batch`` (from 0): rows of a group in order, ``size`` to a batch."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def rolling_windows(tokens: Column, size: int, shared: int = 0) -> Column:
    """array<array<T>>: windows of ``size`` tokens, each sharing ``shared`` with the one
    before; with none shared they are disjoint. The last may be shorter; no tokens, no window."""
    step = size - shared
    last = F.greatest(F.ceil((F.size(tokens) - size) / F.lit(float(step))), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * step + 1, F.lit(size)))
    return F.when(F.size(tokens) > 0, windows).otherwise(F.slice(windows, 1, 0))


def overridden(df: DataFrame, key: str, values: DataFrame, column: str) -> DataFrame:
    """``df`` with the values of a table put over its own, where that has the key and a value."""
    fixed = values.select(F.col(key).alias("_ok"), F.col(column).alias("_ov"))
    joined = df.join(fixed, F.col(key) == F.col("_ok"), "left")
    return joined.select(*[F.coalesce("_ov", column).alias(c) if c == column else c for c in df.columns])


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share, majority): class counts with the baseline that always answers the largest."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"), F.max("n").alias("_top"))
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("n") / F.col("_all")).alias("share"), (F.col("n") == F.col("_top")).alias("majority"))


def aligned_logs(df: DataFrame, key: str, log: str, names: list[str], value: str, at_least: int = 2) -> DataFrame:
    """(key, one column per log): what each of the named logs says of a key, for keys
    in ``at_least`` of them; one aggregate instead of a join per log."""
    of = [F.max(F.when(F.col(log) == n, F.col(value))).alias(n) for n in names]
    both = df.where(F.col(key).isNotNull() & F.col(log).isin(names)).groupBy(key).agg(*of, F.count_distinct(log).alias("_n"))
    return both.where(F.col("_n") >= at_least).drop("_n")


def chosen_column(df: DataFrame, wide: DataFrame, on: tuple[str, str], columns: list[str], choice: Column, value: str) -> DataFrame:
    """``df`` with the column of ``wide`` that ``choice`` names (a NULL or unknown
    name takes the first): the wide table becomes long, then an equi-join."""
    long = wide.unpivot([on[1]], columns, "_name", value)
    known = F.when(choice.isin(columns), choice).otherwise(F.lit(columns[0]))
    rows = df.withColumn("chosen", known)
    return rows.join(long, (F.col(on[0]) == F.col(on[1])) & (F.col("chosen") == F.col("_name")), "left").select(*df.columns, "chosen", value)


def results_table(runs: DataFrame, run: str, results: str) -> DataFrame:
    """(run, task, metric, filter, value, stderr) of results as JSON ``task -> "metric,filter"
    -> value``; errors stand beside their values by one aggregate. Broken JSON and
    what is no number is left out."""
    doc = F.from_json(results, "map<string,map<string,string>>")
    rows = runs.where(F.try_parse_json(results).isNotNull()).select(run, F.explode(doc).alias("task", "_f"))
    rows = rows.select(run, "task", F.explode("_f").alias("_name", "_text")).where("contains(_name, ',')")
    name, value = F.substring_index("_name", ",", 1), F.col("_text").try_cast("double")
    rows = rows.select(run, "task", F.regexp_replace(name, "_stderr$", "").alias("metric"), F.expr("substr(_name, instr(_name, ',') + 1)").alias("filter"), value.alias("_v"), name.endswith("_stderr").alias("_se"))
    out = rows.groupBy(run, "task", "metric", "filter").agg(F.max(F.when(~F.col("_se"), F.col("_v"))).alias("value"), F.max(F.when(F.col("_se"), F.col("_v"))).alias("stderr"))
    return out.where("value IS NOT NULL")


def flat_results(runs: DataFrame, run: str, results: str) -> DataFrame:
    """(run, name, number, text): nested results under ``task/field``, numbers and texts apart."""
    doc = F.from_json(results, "map<string,map<string,string>>")
    rows = runs.select(run, F.explode(doc).alias("_t", "_f")).select(run, "_t", F.explode("_f").alias("_k", "_v"))
    number = F.col("_v").try_cast("double")
    return rows.select(run, F.concat("_t", F.lit("/"), "_k").alias("name"), number.alias("number"), F.when(number.isNull(), F.col("_v")).alias("text"))


def choice_requests(docs: DataFrame, key: str, choices: Column, unconditional: Column | None = None) -> DataFrame:
    """(key, choice, conditional, text): one request per choice of a document, and its
    unconditional copy where asked for, in one generator."""
    part = lambda c, on: F.transform(c, lambda x, i: F.struct(i.alias("choice"), F.lit(on).alias("conditional"), x.alias("text")))
    items = part(choices, True) if unconditional is None else F.concat(part(choices, True), part(unconditional, False))
    return docs.select(key, F.inline(items))
