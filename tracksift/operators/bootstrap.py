"""Standard errors by resampling, for aggregates that have no closed form.

A group's rows are counted by value first. A round draws as many rows as the
group has, with replacement: a multinomial count per different value, from
which the statistic follows by weighted sums; the median's draws have a law of
their own.
Rounds are dealt in chunks, each with its own seed, so the result is the same
at every partitioning; a chunk holds the different values of one group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracksift.operators import corpus_scores

#: Rounds as the evaluated harness runs them, and those of the corpus scores.
ROUNDS = 100_000
MOST_ROUNDS = {"bleu": 100, "chrf": 100, "ter": 100}
#: Rounds of one chunk, and counts held at once.
CHUNK, CELLS = 1000, 2_000_000

#: name -> (counts by round and value, values by row and column) -> statistic by round
STATISTICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "mean": lambda w, x: w @ x[:, 0] / w.sum(1),
    "perplexity": lambda w, x: np.exp(-(w @ x[:, 0]) / w.sum(1)),
}


def statistic(name: str):
    def add(f: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        STATISTICS[name] = f
        return f

    return add


def medians(times: np.ndarray, x: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Medians of resamples, without their other rows: the k-th of n uniform draws
    is Beta(k, n - k + 1), the next one lies a Beta(1, n - k) of the rest above.
    ``x`` is in ascending order; even numbers of rows take the middle of two values."""
    n, upto = int(times.sum()), times.cumsum()
    k = (n + 1) // 2
    low = rng.beta(k, n - k + 1, rounds)
    high = low if n % 2 else low + (1 - low) * rng.beta(1, n - k, rounds)
    a, b = (x[np.searchsorted(upto, np.minimum((u * n).astype(int), n - 1), side="right"), 0] for u in (low, high))
    return (a + b) / 2


def _sides(w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    gold, pred = x[:, 0], x[:, 1]
    return tuple((w @ v).astype(float) for v in (gold * pred, (1 - gold) * (1 - pred), (1 - gold) * pred, gold * (1 - pred)))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


@statistic("f1")
def _f1(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    tp, _, fp, fn = _sides(w, x)
    return _ratio(2 * tp, 2 * tp + fp + fn)


@statistic("matthews")
def _matthews(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    tp, tn, fp, fn = _sides(w, x)
    return _ratio(tp * tn - fp * fn, np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


for _score in ("bleu", "chrf", "ter"):
    STATISTICS[_score] = lambda w, x, s=_score: corpus_scores.score_of_sums(s, w @ x)


def resample(times: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Counts by round and value of ``sum(times)`` draws from rows of which value i has ``times[i]``."""
    n = int(times.sum())
    if len(times) * 4 < n:
        return rng.multinomial(n, times / n, size=rounds)
    row = np.repeat(np.arange(len(times)), times)
    return np.stack([np.bincount(row[rng.integers(0, n, n)], minlength=len(times)) for _ in range(rounds)])


def bootstrap(df: DataFrame, keys: list[str], values: list[str], name: str, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """(keys, stderr) of the statistic ``name`` of the numeric or boolean columns
    ``values``: the standard deviation over the rounds. Rows with a NULL value are
    left out; groups of fewer than two others have no row."""
    rounds = min(rounds, MOST_ROUNDS.get(name, rounds))
    known = df.select(*keys, F.array(*[F.col(v).cast("double") for v in values]).alias("_x")).where(F.forall("_x", F.isnotnull))
    cells = known.groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    dealt = cells.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // CHUNK))))
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("_m", T.DoubleType())])
    arrow, f = to_arrow_schema(schema), STATISTICS.get(name)

    def run(key: tuple, part: pa.Table) -> pa.Table:
        x = part["_x"].combine_chunks().flatten().to_numpy().reshape(-1, len(values))
        order = np.lexsort(x.T[::-1])
        x, times = x[order], part["_c"].to_numpy()[order]
        chunk = key[-1].as_py()
        todo = min(CHUNK, rounds - chunk * CHUNK) if times.sum() > 1 else 0
        rng, step, found = np.random.default_rng([seed, chunk]), max(1, CELLS // len(times)), []
        for at in range(0, todo, step):
            size = min(step, todo - at)
            found.append(medians(times, x, size, rng) if name == "median" else f(resample(times, size, rng), x))
        m = pa.array(np.concatenate(found) if found else [], type=pa.float64())
        return pa.Table.from_arrays([pa.array([k.as_py()] * len(m), type=arrow.field(i).type) for i, k in enumerate(key[:-1])] + [m], schema=arrow)

    return dealt.groupBy(*keys, "_chunk").applyInArrow(run, schema).groupBy(*keys).agg(F.stddev_samp("_m").alias("stderr"))
