"""Test statistics: counts and arithmetic in Spark, p-values on the few result rows."""

from __future__ import annotations

import math

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval for k of n; NULL for n = 0."""
    p = F.try_divide(k.cast("double"), n)
    mid = (p + F.lit(z * z) / (2 * n)) / (1 + F.lit(z * z) / n)
    half = F.lit(z) / (1 + F.lit(z * z) / n) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    return mid - half, mid + half


def chi_square(cells: DataFrame, row: str, col: str, n: str) -> DataFrame:
    """One row (chi2, dof): Pearson's statistic of a contingency table in long
    form, absent cells counting 0, without continuity correction."""
    rows = cells.groupBy(row).agg(F.sum(n).alias("_r"))
    cols = cells.groupBy(col).agg(F.sum(n).alias("_c"))
    total = cells.agg(F.sum(n).cast("double").alias("_n"))
    # the table's margins are its few categories: their grid is the table itself
    grid = rows.crossJoin(cols).crossJoin(total).join(cells, [row, col], "left").withColumn("_e", F.col("_r") * F.col("_c") / F.col("_n"))
    off = F.coalesce(F.col(n), F.lit(0)) - F.col("_e")
    return grid.agg(F.sum(off * off / F.col("_e")).alias("chi2"), ((F.count_distinct(row) - 1) * (F.count_distinct(col) - 1)).alias("dof"))


def holm(df: DataFrame, p: str) -> DataFrame:
    """``df`` with ``p_holm``: step-down adjusted p-values. One window over the
    tests made, which are as few as the hypotheses."""
    w = Window.orderBy(p, *[c for c in df.columns if c != p])
    rank = F.row_number().over(w)
    raw = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy()) - rank + 1) * F.col(p))
    return df.withColumn("_raw", raw).withColumn("p_holm", F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def identity_regression(x: Column, y: Column) -> list[Column]:
    """slope, intercept, and R2 of the prediction y = x."""
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            (1.0 - F.sum((x - y) * (x - y)) / (F.var_pop(y) * F.count(y))).alias("r2_identity")]


def chi_square_p(chi2: float, dof: int) -> float:
    """Upper tail, by the regularised incomplete gamma function's series or fraction."""
    a, x = dof / 2, chi2 / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2x2 table."""
    logs = lambda k: math.lgamma(k + 1)
    r, s, t, n = a + b, a + c, c + d, a + b + c + d
    log_p = lambda k: logs(r) + logs(t) + logs(s) + logs(n - s) - logs(n) - logs(k) - logs(r - k) - logs(s - k) - logs(t - s + k)
    own = log_p(a)
    return min(1.0, sum(math.exp(log_p(k)) for k in range(max(0, s - t), min(r, s) + 1) if log_p(k) <= own + 1e-9))


def _with_p(df: DataFrame, columns: list[str], p_of: Callable[..., float]) -> DataFrame:
    """``df`` with ``p`` of the numbers in ``columns``; NULL where one is."""
    at = [df.columns.index(c) for c in columns]
    schema = T.StructType(df.schema.fields + [T.StructField("p", T.DoubleType())])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for r in rows:
            x = [r[i] for i in at]
            yield *r, None if None in x else float(p_of(*x))

    return map_partition(df, run, schema)


def chi_square_test(cells: DataFrame, row: str, col: str, n: str) -> DataFrame:
    """One row (chi2, dof, p) of a contingency table in long form."""
    return _with_p(chi_square(cells, row, col, n), ["chi2", "dof"], chi_square_p)


def fisher_tests(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """``df`` with the two-sided exact ``p`` of each row's 2x2 table of counts."""
    return _with_p(df, [a, b, c, d], fisher_p)


def slope_p(slope: Column, error: Column) -> Column:
    """Two-sided p of a slope by the normal distribution, as for samples of hundreds;
    the complementary error function in its rational form (error under 1.2e-7)."""
    z = F.abs(slope / error) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = F.lit(terms[-1])
    for x in reversed(terms[:-1]):
        power = power * t + x
    return t * F.exp(-z * z + power)
