"""Corpus BLEU, chrF and TER over pairs of texts.

BLEU and chrF are formulas of counts that add up over pairs: each pair's
clipped n-gram matches are counted in its row, summed by one aggregate and only
the formula is applied to the sums. BLEU cuts words as the mteval-v13a rules do
and halves the share it gives to each further order without a match; chrF is
the F-score of the mean precision and recall over the orders that both sides
have. TER compares without case, needs shifts per pair and runs over Arrow
batches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition

MAX_N, CHAR_N, BETA = 4, 6, 2.0
#: Words a shifted stretch may have, and places it may be moved by (those of the TER tool).
SHIFT_SIZE, SHIFT_DISTANCE = 10, 50

# The rules by which mteval-v13a cuts words.
_ENTITIES = {"&quot;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">"}
_CUTS = [(re.compile(a), b) for a, b in (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "))]


def cut_words(text: str) -> list[str]:
    """Words and marks as the mteval-v13a rules cut them."""
    t = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for name, sign in _ENTITIES.items():
        t = t.replace(name, sign)
    t = f" {t} "
    for rule, put in _CUTS:
        t = rule.sub(put, t)
    return t.split()


def grams(x: Sequence, n: int) -> Counter:
    return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))


def pair_counts(hyp: str, ref: str) -> list[int]:
    """Word n-gram matches and totals (1 to 4), lengths, then character ones (1 to 6)."""
    h, r = cut_words(hyp), cut_words(ref)
    out = []
    for n in range(1, MAX_N + 1):
        a, b = grams(h, n), grams(r, n)
        out += [sum((a & b).values()), sum(a.values())]
    out += [len(h), len(r)]
    hc, rc = "".join(hyp.split()), "".join(ref.split())
    for n in range(1, CHAR_N + 1):
        a, b = grams(hc, n), grams(rc, n)
        out += [sum((a & b).values()), sum(a.values()), sum(b.values())]
    return out


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Edits between two sequences, a column of the table at a time: the steps down a
    column (+1 or -1) are the bits of two numbers, so a column takes a few operations."""
    if not a or not b:
        return len(a) or len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = whole, 0, len(a)
    for y in b:
        same = at.get(y, 0)
        flat = ((((same & up) + up) ^ up) | same | down) & whole
        right, left = (down | ~(flat | up)) & whole, up & flat
        score += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & whole, left << 1 & whole
        up, down = (left | ~(flat | right)) & whole, right & flat
    return score


def translation_edits(hyp: list[str], ref: list[str], max_shift: int = SHIFT_SIZE, max_distance: int = SHIFT_DISTANCE) -> int:
    """Edits with block shifts: as long as moving a stretch that also stands in the
    reference lowers the edit distance by more than the shift's own cost, the best
    such move is made."""
    shifts, words = 0, list(hyp)
    best = edit_distance(words, ref)
    while best > abs(len(words) - len(ref)) + 1:  # no move changes the lengths, nor what they cost
        found = None
        for size in range(min(max_shift, len(words)), 0, -1):
            known = grams(ref, size)
            for i in range(len(words) - size + 1):
                block = words[i : i + size]
                if tuple(block) not in known:
                    continue
                rest = words[:i] + words[i + size :]
                for j in range(max(0, i - max_distance), min(len(rest), i + max_distance) + 1):
                    if j != i:
                        d = edit_distance(moved := rest[:j] + block + rest[j:], ref)
                        if d + 1 < best and (found is None or d < found[0]):
                            found = (d, moved)
        if not found:
            break
        best, words = found
        shifts += 1
    return best + shifts


#: Counts of a pair: word and character n-grams, lengths, translation edits and their reference's words.
COUNTS = MAX_N * 2 + 2 + CHAR_N * 3 + 2


def counted_pairs(df: DataFrame, keys: list[str], hyp: str, ref: str) -> DataFrame:
    """(keys, c0, c1, ...): the counts of each pair; pairs with a NULL side are left out."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(f"c{i}", T.LongType()) for i in range(COUNTS)])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *k, h, r in rows:
            yield *k, *pair_counts(h, r), translation_edits(h.lower().split(), r.lower().split()), len(r.split())

    return map_partition(df.where(F.col(hyp).isNotNull() & F.col(ref).isNotNull()).select(*keys, hyp, ref), run, schema)


def score_of_sums(score: str, sums: np.ndarray) -> np.ndarray:
    """BLEU, chrF or TER of each row of summed counts, as ``corpus_scores`` gives it."""
    c = sums.astype(float).T
    div = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b != 0)
    hyp_len, ref_len, at = c[2 * MAX_N], c[2 * MAX_N + 1], 2 * MAX_N + 2
    if score == "ter":
        return np.where(c[COUNTS - 1] > 0, 100 * div(c[COUNTS - 2], c[COUNTS - 1]), np.nan)
    if score == "bleu":
        hits, totals = c[0 : 2 * MAX_N : 2], c[1 : 2 * MAX_N : 2]
        missed = np.cumsum((totals > 0) & (hits == 0), 0)
        shares = np.where(hits > 0, div(hits, totals), div(np.ones_like(totals), totals * 2.0**missed))
        logs = np.log(np.where(shares > 0, shares, 1.0)).mean(0)
        return np.where((totals > 0).all(0) & (hits > 0).any(0), 100 * np.exp(np.minimum(0.0, 1 - div(ref_len, hyp_len)) + logs), 0.0)
    hits, own, other = (c[at + j : at + 3 * CHAR_N : 3] for j in range(3))
    both = (own > 0) & (other > 0)
    p, r = (div(np.where(both, div(hits, x), 0.0).sum(0), both.sum(0).astype(float)) for x in (own, other))
    return 100 * div((1 + BETA**2) * p * r, BETA**2 * p + r)


def corpus_scores(df: DataFrame, keys: list[str], hyp: str, ref: str) -> DataFrame:
    """(keys, n, bleu, chrf, ter) in percent; pairs with a NULL side are left out."""
    return scores_of_counts(counted_pairs(df, keys, hyp, ref), keys)


def scores_of_counts(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, bleu, chrf, ter) from the pairs' counts."""
    n = COUNTS
    s = counted.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"c{i}").cast("double").alias(f"c{i}") for i in range(n)])
    zero = F.lit(0.0)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    hits, totals = ([F.col(f"c{2 * i + j}") for i in range(MAX_N)] for j in (0, 1))
    missed, logs = F.lit(0), zero
    for m, t in zip(hits, totals):
        missed = missed + F.when((t > 0) & (m == 0), 1).otherwise(0)
        logs = logs + F.ln(F.when(m > 0, m / t).otherwise(F.try_divide(F.lit(1.0), t * F.pow(F.lit(2.0), missed)))) / MAX_N
    hyp_len, ref_len = F.col(f"c{2 * MAX_N}"), F.col(f"c{2 * MAX_N + 1}")
    short = F.when(hyp_len < ref_len, F.exp(1 - F.try_divide(ref_len, hyp_len))).otherwise(1.0)
    bleu = F.when(reduce(lambda a, b: a | b, [m > 0 for m in hits]), F.coalesce(100 * short * F.exp(logs), zero)).otherwise(zero)
    at = 2 * MAX_N + 2
    p = r = orders = zero
    for i in range(CHAR_N):
        m, a, b = (F.col(f"c{at + 3 * i + j}") for j in range(3))
        both = (a > 0) & (b > 0)
        p, r, orders = p + F.when(both, m / a).otherwise(0.0), r + F.when(both, m / b).otherwise(0.0), orders + F.when(both, 1.0).otherwise(0.0)
    p, r = share(p, orders), share(r, orders)
    chrf = 100 * share((1 + BETA**2) * p * r, BETA**2 * p + r)
    return s.select(*keys, "n", bleu.alias("bleu"), chrf.alias("chrf"), (100 * F.try_divide(F.col(f"c{n - 2}"), F.col(f"c{n - 1}"))).alias("ter"))


def normal_z(se: float, diff: float) -> float:
    """Two-sided p of a difference with standard error ``se``."""
    return math.erfc(abs(diff) / se / math.sqrt(2)) if se else 1.0
