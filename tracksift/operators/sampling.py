"""Samples, shards, limits and order, all deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.operators.ranks import RANGE, ranged, running_total


def numbered(df: DataFrame, order: str, out: str = "_n") -> DataFrame:
    """``df`` with its position (from 1) in a total order, by running counts of
    ranges of about equally many rows rather than one global window."""
    return running_total(ranged(df, [order]), [], F.col(RANGE), [order], F.lit(1), out).drop(RANGE)


def limit_fraction(df: DataFrame, order: str, limit: float) -> DataFrame:
    """The first ``limit`` rows, or that share of all (rounded up) if below 1."""
    n = df.count()
    keep = -(-int(n * limit * 1_000_000) // 1_000_000) if limit < 1 else int(limit)
    return numbered(df, order).where(F.col("_n") <= keep).drop("_n")


def stride_shard(df: DataFrame, order: str, rank: int, world: int, limit: int | None = None) -> DataFrame:
    """Every world-th row from ``rank`` on, of the first ``limit``."""
    rows = numbered(df, order)
    at = F.col("_n") - 1
    keep = F.pmod(at, F.lit(world)) == rank
    return rows.where(keep if limit is None else keep & (at < limit)).drop("_n")


def balanced_split(df: DataFrame, order: str, parts: int) -> DataFrame:
    """``df`` with ``part`` (from 1): contiguous, sizes differing by one, larger first."""
    n = df.count()
    q, r = divmod(n, parts)
    at = F.col("_n") - 1
    part = F.when(at < (q + 1) * r, F.floor(at / (q + 1))).otherwise(F.lit(r) + F.floor((at - (q + 1) * r) / max(q, 1)))
    return numbered(df, order).withColumn("part", part + 1).drop("_n")


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows whose keys hash lowest: a top-n, so partitions pass on n rows each."""
    return df.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)).orderBy("_h").limit(n).drop("_h")


def draw(seed: int, part: str, *of: Column) -> Column:
    """A number from 0 to 2^32 - 1 drawn by what it is for; SQL engines give the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(part), *[c.cast("string") for c in of])), 1, 8), 16, 10).cast("bigint")


def fewshot(docs: DataFrame, key: str, pool: DataFrame, pool_key: str, n: int, seed: int) -> DataFrame:
    """(key, shot_no, pool_key): for each document ``n`` examples of its own draw
    from the pool, without itself, in drawn order.

    The pool, in the order of its (integer, unique) key, is cut into n + 1 equal
    strata and one place is drawn in each, so the examples differ and no document
    meets the whole pool: what is joined is n + 1 rows per document. A pool of
    n + 1 examples or fewer is used whole. NULL keys are left out on both sides.
    """
    numbered_pool = numbered(pool.where(F.col(pool_key).isNotNull()).select(F.col(pool_key).alias("_shot")), "_shot", "_at")
    size = numbered_pool.count()
    strata = min(n + 1, size)
    if not strata:
        return docs.select(key, F.lit(0).alias("shot_no"), F.col(key).alias(pool_key)).where("false")
    rows = docs.where(F.col(key).isNotNull()).select(key, F.explode(F.sequence(F.lit(0), F.lit(strata - 1))).alias("_j"))
    low, high = F.floor(F.col("_j") * size / strata), F.floor((F.col("_j") + 1) * size / strata)
    asked = rows.withColumn("_at", (1 + low + F.pmod(draw(seed, "at", F.col(key), F.col("_j")), high - low)).cast("bigint"))
    found = asked.join(numbered_pool.select(F.col("_at").cast("bigint").alias("_at"), "_shot"), "_at").where(F.col("_shot") != F.col(key))
    order = F.struct(draw(seed, "order", F.col(key), F.col("_j")).alias("o"), "_j", "_shot")
    drawn = found.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(order)), 1, n).alias("_s"))
    return drawn.select(key, F.posexplode(F.transform("_s", lambda x: x["_shot"])).alias("shot_no", pool_key))


def first_n(docs: DataFrame, key: str, pool: DataFrame, pool_key: str, n: int) -> DataFrame:
    """(key, shot_no, pool_key): the same first ``n`` examples of the pool for each document."""
    head = pool.where(F.col(pool_key).isNotNull()).orderBy(pool_key).limit(n).agg(F.array_sort(F.collect_list(pool_key)).alias("_s"))  # one row of n
    return docs.select(key).crossJoin(F.broadcast(head)).select(key, F.posexplode("_s").alias("shot_no", pool_key))


def natural_key(text: Column) -> Column:
    """A sort key in which numbers inside a name count as numbers, whatever their
    length: a number is led by how many digits it has without leading zeros."""
    def piece(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(F.regexp_like(p, F.lit("^[0-9]")), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(F.lower(p))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), piece), "")


def folded_key(text: Column) -> Column:
    """A sort key without case and outer blanks."""
    return F.lower(F.trim(text))


def model_order(name: Column) -> list[Column]:
    """Columns that sort model names by family, then by size in billions (``3p5b`` is 3.5), then by name."""
    family = F.lower(F.regexp_extract(name, "^([A-Za-z]+)", 1))
    size = F.replace(F.lower(F.regexp_extract(name, r"(?i)([0-9]+(?:[p.][0-9]+)?)b(?![a-z])", 1)), F.lit("p"), F.lit(".")).try_cast("double")
    return [family, F.coalesce(size, F.lit(-1.0)), name]


def reordered(df: DataFrame, order: list[str], index: str = "_place") -> DataFrame:
    """``df`` numbered by an integer column and sorted within its partitions by ``order``;
    ``restored`` brings rows made from it back into their first order."""
    return numbered(df, index if index in df.columns else order[0], "_place").sortWithinPartitions(*order)


def restored(answered: DataFrame, place: str = "_place") -> DataFrame:
    """Rows in the order they had before ``reordered``."""
    return answered.orderBy(place).drop(place)
