"""Interval-overlap and as-of joins without products within a key.

An equi-join on the entity with a range condition compares every pair of an
entity's intervals. Here intervals are spread over coarse time buckets first
and joined on (entity, bucket); a pair is kept in the bucket where its overlap
starts only, so it comes out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.session import materialize

#: Bytes of needles that are broadcast, and of a row besides its values.
FEW_NEEDLES, ROW_BYTES = 4_000_000, 100


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int, label: str = "label") -> DataFrame:
    """Pairs with max(t0) < min(t1): (keys, a_t0, a_t1, a_label, b_t0, b_t1, b_label, t0, t1).

    Both sides have the keys, integer t0 and t1 and a label. ``bucket`` should be
    about the length of a typical interval.
    """

    def spread(df: DataFrame, p: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("t0") / bucket), F.floor((F.col("t1") - 1) / bucket))
        return df.where("t1 > t0").select(*keys, F.col("t0").alias(f"{p}_t0"), F.col("t1").alias(f"{p}_t1"), F.col(label).alias(f"{p}_label"), F.explode(cells).alias("_b"))

    pairs = spread(left, "a").join(spread(right, "b"), [*keys, "_b"])
    t0, t1 = F.greatest("a_t0", "b_t0"), F.least("a_t1", "b_t1")
    return pairs.withColumn("t0", t0).withColumn("t1", t1).where((F.col("t0") < F.col("t1")) & (F.floor(F.col("t0") / bucket) == F.col("_b"))).drop("_b")


def asof_join(probes: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, default: str | None = None, clamp: bool = False) -> DataFrame:
    """``probes`` (keys, probe_id, at) with the value of the last mark at or
    before ``at``; before the first mark the default, or with ``clamp`` the first
    mark's value. One union and one sort
    per entity; of several marks of one instant the largest value counts."""
    p = probes.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(marks.schema[value].dataType).alias("_v"), "probe_id")
    m = marks.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = p.unionByName(m).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    if clamp:
        out = out.withColumn("_next", F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    out = out.where("_side = 1")
    return out.select(*keys, "probe_id", F.col("_t").alias(at), F.coalesce("_last", *(["_next"] if clamp else []), F.lit(default)).alias(value))


def substring_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, n: int) -> DataFrame:
    """Pairs where ``needle`` is contained in ``text``, joined on the needle's first
    ``n`` characters among the text's n-grams (each once per text) and then
    checked. Shorter needles are joined on the text's shorter grams, the empty one
    with every text.

    Spark takes an exploded side for as small as it was before, so which side is
    broadcast isn't left to it: the needles are written once and measured; up to
    FEW_NEEDLES bytes they are broadcast and no text is shuffled, more are joined by a
    merge. The texts' grams are never broadcast."""
    size = F.length(text)

    def pieces(k: int) -> Column:
        at = F.when(size >= k, F.sequence(F.lit(1), F.greatest(size - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(F.col(text), i, F.lit(k)))

    every = F.array_distinct(F.concat(F.array(F.lit("")), *[pieces(k) for k in range(1, n + 1)]))
    grams = texts.where(F.col(text).isNotNull()).withColumn("_g", F.explode(every))
    known = materialize(needles.where(F.col(needle).isNotNull()).withColumn("_g", F.substring(needle, 1, n)), "needles")
    few = (known.agg(F.sum(ROW_BYTES + F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= FEW_NEEDLES
    return grams.join(known.hint("broadcast" if few else "merge"), "_g").where(F.contains(F.col(text), F.col(needle))).drop("_g")
