"""Mixing sources to target weights, by entropy balancing.

Document rates stay as close (in relative entropy) to one common rate as the
token targets of the sources allow; the dual has one multiplier per source and
gives rates tilted exponentially with a document's tokens, cut at the number
of repeats its source may have. Newton steps on the dual need sums per source
only, taken over the exact histogram of (source, tokens). Rates become whole
copies by dithered rounding, whose offset per source is chosen so that the
tokens really used meet the target.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition
from tracksift.session import materialize

#: Share of the largest total the repeats allow that is asked for; Newton's
#: tolerance; offsets tried per pass over the documents, and passes.
FILL, TOLERANCE, OFFSETS, PASSES = 0.9, 1e-6, 16, 3
#: Sources up to which their parameters are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000

# Fixed value: how the vocabulary's texts are cut into words before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A byte-level tokenizer from a public rank file; loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and n_tokens of the whole text; NULL and '' have none."""
    schema = T.StructType([df.select(*keep).schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = tokenizer(path).encode_ordinary
        for *rest, t in rows:
            yield *rest, len(encode(t)) if t else 0

    return map_partition(df.select(*keep, text), run, schema)


def source_name(text: Column) -> Column:
    """A source without case, outer blanks and ways of joining its words."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s\-]+", "_")


def _joined(df: DataFrame, values: dict[str, tuple], names: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the numbers that belong to its source."""
    spark = df.sparkSession
    rows = [(s, *map(float, v)) for s, v in values.items()]
    params = spark.createDataFrame(rows, ", ".join(["`__source` string", *[f"`{n}` double" for n in names]]))
    params = F.broadcast(params) if len(rows) <= BROADCAST_SOURCES else params
    return df.join(params, F.col("source") == F.col("__source"), how).drop("__source")


def _tilted(rate: float) -> Column:
    """A document's rate before its source's cap, from its tokens over the source's mean."""
    power = F.col("_m") * F.col("n_tokens") / F.col("_mean")
    return F.lit(rate) * F.exp(F.least(F.greatest(power, F.lit(-700.0)), F.lit(700.0)))


def balance(sizes: DataFrame, goals: dict[str, float], caps: dict[str, int], rate: float, means: dict[str, float]) -> dict[str, float]:
    """The multiplier of each source, so that its rates ``rate * exp(multiplier *
    tokens / mean)``, cut at its cap, give its goal of tokens.

    ``sizes`` has source, n_tokens, n. The Hessian of the dual is diagonal
    (sources share no document); each step is kept inside a bracket that
    shrinks, so a flat stretch at the caps can't throw it off.
    """
    multiplier = dict.fromkeys(goals, 0.0)
    bracket = {s: [-700.0, 700.0] for s in goals}
    todo = set(goals)
    t, n, free, cap = F.col("n_tokens").cast("double"), F.col("n"), F.col("_free"), F.col("_cap")
    for _ in range(100):
        rated = _joined(sizes, {s: (multiplier[s], means[s], caps[s]) for s in todo}, ["_m", "_mean", "_cap"]).withColumn("_free", _tilted(rate))
        sums = {r["source"]: (r["g"] or 0.0, r["h"] or 0.0) for r in rated.groupBy("source").agg(
            F.sum(n * t * F.least(free, cap)).alias("g"), F.sum(F.when(free < cap, n * t * t / F.col("_mean") * free)).alias("h")).collect()}
        for k in list(todo):
            g, h = sums.get(k, (0.0, 0.0))
            off = g - goals[k]
            if abs(off) <= TOLERANCE * goals[k] or k not in sums:
                todo.discard(k)
                continue
            bracket[k][off > 0] = multiplier[k]
            step = multiplier[k] - off / h if h > 0 else math.inf
            if not bracket[k][0] < step < bracket[k][1]:
                step = sum(bracket[k]) / 2
            multiplier[k] = step
        if not todo:
            break
    return multiplier


def mix(docs: DataFrame, key: str, targets: list[tuple[str, float, int]], total: float | None = None, seed: int = 0) -> DataFrame:
    """Rows (key, source, n_tokens, n_uses, target_share, real_share), one per document.

    ``docs`` has key (unique), source (as in the targets) and n_tokens;
    ``targets`` are (source, share, max_repeats). ``total`` defaults to FILL of
    the largest total the repeats allow. Documents of no target source, of a
    NULL source or without tokens are used 0 times and keep NULL shares where
    they have no target; a source without tokens reaches 0 and the others share
    out as asked. An empty table gives no row.
    """
    docs = materialize(docs.select(key, "source", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), "sizes")
    wanted = {s: share for s, share, _ in targets if share > 0}
    caps = {s: int(r) for s, _, r in targets}
    if not wanted:
        return docs.select(key, "source", "n_tokens", F.lit(0).cast("bigint").alias("n_uses"),
                           F.lit(None).cast("double").alias("target_share"), F.lit(None).cast("double").alias("real_share"))
    known = _joined(docs.where("n_tokens > 0"), dict.fromkeys(wanted, ()), [])
    sizes = materialize(known.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "histogram")
    stats = {r["source"]: r for r in sizes.groupBy("source").agg(
        F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("n")).collect()}
    here = {s: w for s, w in wanted.items() if s in stats and caps[s] > 0}
    if not here:
        return docs.select(key, "source", "n_tokens", F.lit(0).cast("bigint").alias("n_uses"),
                           F.lit(None).cast("double").alias("target_share"), F.lit(None).cast("double").alias("real_share"))
    most = min(caps[s] * stats[s]["t"] / w for s, w in here.items()) * sum(here.values())
    total = min(FILL * most if total is None else total, most)
    goals = {s: total * w / sum(here.values()) for s, w in here.items()}
    rate = total / sum(stats[s]["t"] for s in here)
    means = {s: stats[s]["t"] / stats[s]["n"] for s in here}
    multiplier = balance(sizes, goals, caps, rate, means)

    dither = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rated = _joined(known, {s: (multiplier[s], means[s], caps[s]) for s in here}, ["_m", "_mean", "_cap"])
    rated = rated.select(key, "source", "n_tokens", F.least(_tilted(rate), "_cap").alias("_w"), dither.alias("_u"), "_cap")

    def copies(offset: Column) -> Column:
        return F.least(F.greatest(F.floor(F.col("_w") + F.col("_u") + offset), F.lit(0)), F.col("_cap")).cast("bigint")

    offset, width = dict.fromkeys(here, 0.0), 0.5
    for _ in range(PASSES):
        steps = [width * (2 * i / OFFSETS - 1) for i in range(OFFSETS + 1)]
        got = _joined(rated, {s: (x,) for s, x in offset.items()}, ["_o"]).groupBy("source").agg(*[
            F.sum(F.col("n_tokens") * copies(F.col("_o") + F.lit(d))).alias(f"g{i}") for i, d in enumerate(steps)]).collect()
        for r in got:
            k = r["source"]
            i = min(range(len(steps)), key=lambda i: (abs(r[f"g{i}"] - goals[k]), abs(steps[i])))
            offset[k] += steps[i]
        width /= OFFSETS / 2
    used = materialize(_joined(rated, {s: (x,) for s, x in offset.items()}, ["_o"]).select(F.col(key).alias("_key"), "source", "n_tokens", copies(F.col("_o")).alias("n_uses")), "uses")
    reached = {r["source"]: r["g"] for r in used.groupBy("source").agg(F.sum(F.col("n_uses") * F.col("n_tokens")).alias("g")).collect()}
    whole = sum(reached.values()) or 1
    shares = {k: (w, reached.get(k, 0) / whole) for k, w in wanted.items()}
    out = docs.join(used.select("_key", "n_uses"), docs[key] == F.col("_key"), "left").select(docs[key], "source", "n_tokens", F.coalesce("n_uses", F.lit(0)).alias("n_uses"))
    return _joined(out, shares, ["target_share", "real_share"], "left").select(key, "source", "n_tokens", "n_uses", "target_share", "real_share")
