"""Covered periods and gaps of overlapping intervals, by a sweep line.

Boundaries become +1 and -1 events; the running sum per entity is the number of
open intervals, a period lasts while it is positive, a gap while it is zero
between two periods. Intervals are first cut at a fixed time grid and the sweep
runs per (entity, cell), so an entity with a third of all rows is spread over
many tasks; a cell holds at most ``cell_ms`` distinct instants because events of
one instant are summed before the sort. What touches a cell's border is merged
afterwards by the same sweep over a few rows per cell. An interval is cut into
three parts at most, however long it is: the cells that it covers whole are one
part, which goes to that second sweep; what cells found for themselves that lie
under one is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.session import materialize

CELL_MS = 600_000


def clock_seconds(text: Column) -> Column:
    """Seconds of ``ss.mmm``, ``mm:ss.mmm`` or ``hh:mm:ss.mmm``; NULL if malformed."""
    return F.aggregate(
        F.split(text, ":"), F.lit(0.0), lambda acc, part: acc * 60.0 + part.try_cast("double")
    )


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, half up (``round`` goes through decimals, which costs more)."""
    return F.floor(seconds * 1000.0 + 0.5)


def time_spans(blocks: Column) -> Column:
    """All ``<TIME> start-end`` spans of a text as array<struct<start_ms, end_ms>>.

    Start and end are clock times or seconds (an ``s`` may follow), joined by
    a hyphen, a dash or ``to``.
    """
    number = r"([0-9]+(?::[0-9]+)*(?:\.[0-9]+)?)"
    pattern = rf"(?i)<\s*TIME\s*>\s*{number}\s*s?\s*(?:-|–|—|to)\s*{number}"
    starts = F.regexp_extract_all(blocks, F.lit(pattern), F.lit(1))
    ends = F.regexp_extract_all(blocks, F.lit(pattern), F.lit(2))
    return F.zip_with(
        starts, ends,
        lambda a, b: F.struct(to_ms(clock_seconds(a)).alias("start_ms"), to_ms(clock_seconds(b)).alias("end_ms")),
    )


def _deltas(start: Column, end: Column) -> Column:
    return F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, cell_ms: int = CELL_MS) -> DataFrame:
    """Rows (``*keys``, kind, start_ms, end_ms): maximal periods and the gaps between them.

    ``start`` and ``end`` are integers. Rows with a NULL key or boundary and
    intervals of no or negative length cover nothing; touching intervals form
    one period; repeated rows change nothing; an empty table gives no row.
    Columns beyond those named are ignored.
    """
    if cell_ms < 1:
        raise ValueError("cell_ms must be positive")
    k = [f"_k{i}" for i in range(len(keys))]
    iv = df.select(
        *[df[name].alias(a) for name, a in zip(keys, k)],
        df[start].cast("bigint").alias("_s"), df[end].cast("bigint").alias("_e"),
    )
    iv = iv.where(" AND ".join(f"{a} IS NOT NULL" for a in k) + " AND _s < _e")
    cell = lambda x: F.floor(x / F.lit(cell_ms)).cast("bigint")
    first, last = cell(F.col("_s")), cell(F.col("_e") - 1)
    pieces = iv.select(*k, "_s", "_e", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))).alias("_c"))
    # first cell covered whole by an interval, and first one after those
    whole = materialize(iv.where(last - first > 1).select(*k, (first + 1).alias("_from"), last.alias("_upto")), "whole")
    lo, hi = F.col("_c") * cell_ms, (F.col("_c") + 1) * cell_ms
    events = pieces.select(
        *k, "_c", F.inline(_deltas(F.greatest(F.col("_s"), lo), F.least(F.col("_e"), hi)))
    )
    net = events.groupBy(*k, "_c", "t").agg(F.sum("d").alias("d")).where("d <> 0")
    w = Window.partitionBy(*k, "_c").orderBy("t")
    active = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # a period opens where the count was zero and closes where it is zero again
    turns = net.withColumn("_n", active).where("_n = 0 OR _n = d")
    spans = turns.select(
        *k, "_c", "_n", F.col("t").alias("_a"), F.lead("t", 1).over(w).alias("_b"), F.lead("t", 2).over(w).alias("_next")
    ).where("_n > 0")

    inner = (F.col("_a") > lo) & (F.col("_b") < hi)
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start_ms"), b.alias("end_ms"))
    own = spans.select(
        *k, "_c",
        F.inline(F.filter(
            F.array(
                F.when(inner, piece("period", F.col("_a"), F.col("_b"))),
                F.when(F.col("_next").isNotNull(), piece("gap", F.col("_b"), F.col("_next"))),
            ),
            lambda x: x.isNotNull(),
        )),
    )

    # per cell: its hull, and its periods that touch the border
    cells = spans.groupBy(*k, "_c").agg(
        F.min(F.struct("_a", "_b")).alias("_f"), F.max(F.struct("_a", "_b")).alias("_l")
    )
    # cells under a part that covers them whole, by a sweep over cells
    steps = whole.select(*k, F.inline(F.array(F.struct(F.col("_from").alias("_c"), F.lit(1).alias("d")), F.struct(F.col("_upto").alias("_c"), F.lit(-1).alias("d")))))
    marks = steps.groupBy(*k, "_c").agg(F.sum("d").alias("d")).withColumn("_here", F.lit(False)).unionByName(
        cells.select(*k, "_c", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("_here")))
    upto = Window.partitionBy(*k).orderBy("_c").rangeBetween(Window.unboundedPreceding, 0)
    under = marks.withColumn("_n", F.sum("d").over(upto)).where("_here AND _n > 0").select(*[F.col(a).alias(f"_u{a}") for a in k], F.col("_c").alias("_uc"))
    same = F.col("_c") == F.col("_uc")
    for a in k:
        same = same & (F.col(a) == F.col(f"_u{a}"))
    left, right = F.col("_f._a") == lo, F.col("_l._b") == hi
    one = F.col("_f._a") == F.col("_l._a")
    joint = cells.select(
        *k,
        F.inline(F.filter(
            F.array(
                piece("hull", F.col("_f._a"), F.col("_l._b")),
                F.when(left | (one & right), piece("edge", F.col("_f._a"), F.col("_f._b"))),
                F.when(right & ~one, piece("edge", F.col("_l._a"), F.col("_l._b"))),
            ),
            lambda x: x.isNotNull(),
        )),
    )
    done = own.join(under, same, "left_anti").drop("_c")
    covered = whole.select(*k, F.inline(F.array(*[piece(x, F.col("_from") * cell_ms, F.col("_upto") * cell_ms) for x in ("hull", "edge")])))
    joint = joint.unionByName(covered)
    turns2 = (
        joint.select(*k, "kind", F.inline(_deltas(F.col("start_ms"), F.col("end_ms"))))
        .groupBy(*k, "kind", "t").agg(F.sum("d").alias("d")).where("d <> 0")
    )
    w2 = Window.partitionBy(*k, "kind").orderBy("t")
    open2 = F.sum("d").over(w2.rowsBetween(Window.unboundedPreceding, 0))
    joined = (
        turns2.withColumn("_n", open2).where("_n = 0 OR _n = d").withColumn("_b", F.lead("t").over(w2))
        .where("(kind = 'edge' AND _n > 0) OR (kind = 'hull' AND _n = 0 AND _b IS NOT NULL)")
        .select(
            *k, F.when(F.col("kind") == "edge", "period").otherwise("gap").alias("kind"),
            F.col("t").alias("start_ms"), F.col("_b").alias("end_ms"),
        )
    )
    out = done.unionByName(joined)
    return out.select(*[out[a].alias(name) for name, a in zip(keys, k)], "kind", "start_ms", "end_ms")
