"""Choosing rows and columns by parameters: lists, patterns, ranges, flags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parameter(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A parameter that the session's configuration may override (``tracksift.<name>``)."""
    return spark.conf.get(f"tracksift.{name}", default)


def listed(column: Column, names: str | None) -> Column:
    """Whether a value is in a comma-separated list; ``all``, '' or None take every row, NULLs too."""
    wanted = [x.strip() for x in (names or "").split(",") if x.strip()]
    return F.lit(True) if not wanted or "all" in wanted else F.coalesce(column.isin(wanted), F.lit(False))


def select_rows(df: DataFrame, column: str, names: str | None = None, pattern: str | None = None, without: str | None = None) -> DataFrame:
    """Rows whose ``column`` is listed in ``names``. A ``pattern``, found anywhere in
    it, takes the place of all other conditions; ``without`` leaves out what it is
    found in. A NULL is listed only by ``all`` and matches no pattern."""
    value = F.col(column)
    if pattern:
        return df.where(F.coalesce(value.rlike(pattern), F.lit(False)))
    out = df.where(listed(value, names))
    return out.where(~F.coalesce(value.rlike(without), F.lit(False))) if without else out


def flagged(df: DataFrame, flag: str, prefix: str = "") -> DataFrame:
    """Rows whose flag column, named at run time (``is_`` + name), is true."""
    return df.where(F.coalesce(F.col(prefix + flag).cast("boolean"), F.lit(False)))


def range_values(spec: str) -> list[int]:
    """The numbers of ``3-17,19,30-28``, in order, each once; a range the wrong way
    round is turned. Anything else is an error."""
    out: set[int] = set()
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m:
            raise ValueError(f"not a range: {part!r}")
        a, b = sorted((int(m[1]), int(m[2] or m[1])))
        out.update(range(a, b + 1))
    return sorted(out)


def range_overlap(low: Column, high: Column, spec: str) -> Column:
    """Whether [low, high] holds any number of a range spec; false for NULLs."""
    runs: list[list[int]] = []
    for n in range_values(spec):
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    out = F.lit(False)
    for a, b in runs:
        out = out | ((low <= b) & (high >= a))
    return F.coalesce(out, F.lit(False))


def complete_groups(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows of the groups that have exactly ``size`` rows: counted first, then joined, so no group is gathered."""
    whole = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") == size).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(whole, same, "left_semi")


def without_media(df: DataFrame) -> DataFrame:
    """``df`` without columns that hold bytes, at any depth."""
    def has_bytes(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return any(has_bytes(f.dataType) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return has_bytes(t.elementType)
        if isinstance(t, T.MapType):
            return has_bytes(t.keyType) or has_bytes(t.valueType)
        return isinstance(t, T.BinaryType)

    return df.select(*[f.name for f in df.schema.fields if not has_bytes(f.dataType)])


def member_flag(df: DataFrame, keys: list[str], others: DataFrame, out: str = "is_member") -> DataFrame:
    """``df`` with whether its ``keys`` stand together in ``others``; NULL keys match NULLs."""
    there = others.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct().withColumn("_there", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(there, same, "left").select(*df.columns, F.coalesce("_there", F.lit(False)).alias(out))


def both_sides(df: DataFrame, keys: list[str], side: str, value: str, names: tuple[str, str]) -> DataFrame:
    """(keys, value_<name> ...): rows of two sides in long form met by their keys, in
    one aggregate instead of a join with itself; groups that lack a side are left out."""
    cols = [F.max(F.when(F.col(side) == n, F.col(value))).alias(f"{value}_{n}") for n in names]
    seen = [F.count_if(F.col(side) == n).alias(f"_{i}") for i, n in enumerate(names)]
    return df.groupBy(*keys).agg(*cols, *seen).where("_0 > 0 AND _1 > 0").drop("_0", "_1")


def swapped_union(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` and once more with every column that ends in one suffix renamed to the other and back."""
    other = lambda c: c[: -len(a)] + b if c.endswith(a) else c[: -len(b)] + a if c.endswith(b) else c
    return df.unionByName(df.select(*[F.col(c).alias(other(c)) for c in df.columns]))


def ordered_list(df: DataFrame, keys: list[str], order: str, value: str, separator: str) -> DataFrame:
    """(keys, value): the values of a key in order as one text, as of the questions that belong to a video."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["v"]), separator).alias(value))


def transposed_blocks(blocks: Column, ids: Column) -> Column:
    """array<struct<qid, block, value>> of blocks of answers (array<array<T>>), one per
    question and block; an error if a block hasn't one answer per question."""
    right = F.forall(blocks, lambda b: F.size(b) == F.size(ids))
    rows = F.flatten(F.transform(ids, lambda q, i: F.transform(blocks, lambda b, j: F.struct(
        q.alias("qid"), j.alias("block"), F.get(b, i).alias("value")))))
    return F.when(right, rows).when(blocks.isNotNull() & ids.isNotNull(), F.raise_error(F.lit("a block has not one answer per question")).cast(
        "array<struct<qid:string,block:int,value:string>>"))
