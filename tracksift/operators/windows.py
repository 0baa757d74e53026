"""Frame windows and sampled frames as arrays, and thresholds over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_stride(fps: Column, target: float) -> Column:
    """Frames per sample, half to even, at least 1."""
    return F.greatest(F.bround(fps / target).cast("int"), F.lit(1))


def dense_windows(n_frames: Column, k: int, overlap: int = 0, stride: int = 1) -> Column:
    """array<struct<first, last>> of windows of ``k`` frames each ``stride`` apart,
    ``overlap`` shared with the next; the last one is cut at the end and none
    begins after one that reached it."""
    step, span = (k - overlap) * stride, k * stride
    last = F.greatest(F.ceil((n_frames - span) / step), F.lit(0))
    at = F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))
    windows = F.transform(at, lambda i: F.struct((i * step).alias("first"), F.least(i * step + span, n_frames).alias("last")))
    return F.when(n_frames > 0, windows).otherwise(F.slice(windows, 1, 0))


def uniform_frames(n_frames: Column, k: int) -> Column:
    """``k`` frames from the first to the last, equally far apart, rounded down; all if there are fewer."""
    few = F.sequence(F.lit(0).cast("bigint"), F.greatest(n_frames - 1, F.lit(0)).cast("bigint"))
    many = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda i: F.floor(i * (n_frames - 1) / (k - 1)))
    return F.when(n_frames < k, few).otherwise(many)


def threshold_time(df: DataFrame, keys: list[str], order: list[str], count: str, end: str, threshold: int) -> DataFrame:
    """(keys, reached_at): the end of the first window at which the running count
    reaches the threshold; NULL if it never does. NULL counts are skipped."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(count).over(w)).groupBy(*keys).agg(F.min(F.when(F.col("_sum") >= threshold, F.col(end))).alias("reached_at"))


def moved(points: DataFrame, keys: list[str], frame: str, threshold: float, min_frames: int = 4, confidence: float = 0.9) -> DataFrame:
    """(keys, moved): whether a point moved, by the larger coordinate, more than
    ``threshold`` per frame between first and last; NULL if there are too few
    frames or either end isn't sure. ``points`` has frame, x, y, conf."""
    first, last = F.min_by(F.struct("x", "y", "conf"), frame), F.max_by(F.struct("x", "y", "conf"), frame)
    ends = points.groupBy(*keys).agg(first.alias("_a"), last.alias("_b"), F.count("*").alias("_n"))
    far = F.greatest(F.abs(F.col("_b.x") - F.col("_a.x")), F.abs(F.col("_b.y") - F.col("_a.y")))
    sure = (F.col("_n") >= min_frames) & (F.col("_a.conf") >= confidence) & (F.col("_b.conf") >= confidence)
    return ends.select(*keys, F.when(sure, far > threshold * (F.col("_n") - 1)).alias("moved"))
