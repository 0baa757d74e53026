"""Running positions that stay distributed when one key holds most rows.

A window over a hot key would sort a third of the table in one task. Here the
order column is cut into buckets first: bucket counts are summed per key (a
small table), their running sum gives each bucket its offset, and rows are
numbered within (key, bucket) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.session import materialize, shuffle_parts


#: Column that says which range of its order a row lies in.
RANGE = "__range"


def ranged(df: DataFrame, by: list[str]) -> DataFrame:
    """``df``, written in ranges of ``by`` of about equally many rows, with the number
    of a row's range as RANGE: a bucket for ``running_total``.

    Ranges are as many as the session's shuffle partitions and are taken from the
    rows themselves, so neither a hot key (with its order in ``by``) nor a few far
    values put more into one than belongs there. Rows equal in ``by`` share one.
    """
    parts = shuffle_parts(df.sparkSession)
    return materialize(df.repartitionByRange(parts, *by).withColumn(RANGE, F.spark_partition_id()), "ranged")


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same keys
    that come before the row or are it, ordered by (bucket, *order).

    ``bucket`` must not decrease along ``order``. Keys and order may be NULL
    (a group of their own, first); ties are in an arbitrary order, so ``order``
    should be unique within keys.
    """
    rows = df.withColumn("__rt_b", bucket).withColumn("__rt_v", value)
    before = Window.partitionBy(*keys).orderBy("__rt_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "__rt_b").agg(F.sum("__rt_v").alias("__rt_s"))
        .withColumn("__rt_off", F.coalesce(F.sum("__rt_s").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"__rt_o_{k}") for k in keys], F.col("__rt_b").alias("__rt_o_b"), "__rt_off")
    )
    within = Window.partitionBy(*keys, "__rt_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__rt_run", F.sum("__rt_v").over(within))
    match = F.col("__rt_b").eqNullSafe(F.col("__rt_o_b"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__rt_o_{k}"))
    return local.join(offsets, match).select(*df.columns, (F.col("__rt_run") + F.col("__rt_off")).alias(out))
