"""Splits that keep related records together.

Related codes are the nodes of a graph; Boruvka rounds let every component
pick its least outgoing edge at once and contract the picked edges, so the
number of components at least halves per round. The picked edges are kept as a
spanning forest with their roots. The roots' groups are then stratified by size
band and traits and dealt systematically: along the strata, largest band first,
each group goes to the split that is furthest behind its share of the rows
dealt so far, and what one stratum leaves uneven is carried to the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition
from tracksift.session import discard, materialize

#: A round at least halves the components, so this is beyond any possible input.
MAX_ROUNDS = 64
#: Groups that one task deals; orders within the strata that are tried; parts a
#: trait's values are hashed to for comparing those; weight of the rows beside a trait.
SEGMENT, STARTS, TRAIT_PARTS, ROW_WEIGHT = 50_000, 64, 64, 16.0


def patient_code(text: Column) -> Column:
    """``S`` or ``C`` and five digits from a free spelling (``(s_0518)``); NULL if there is none."""
    kind = F.upper(F.regexp_extract(text, r"(?i)([SC])[^0-9A-Za-z]*[0-9]+", 1))
    digits = F.regexp_replace(F.regexp_extract(text, r"(?i)[SC][^0-9A-Za-z]*([0-9]+)", 1), "^0+(?=.)", "")
    return F.when((kind != "") & (F.length(digits) <= 5), F.concat(kind, F.lpad(digits, 5, "0")))


def _jump(parents: DataFrame) -> DataFrame:
    """(comp, parent) with every parent replaced by its root, by pointer jumping."""
    while True:
        up = parents.select(F.col("comp").alias("parent"), F.col("parent").alias("up"))
        done = parents
        parents = materialize(
            parents.select("comp", "parent").join(up, "parent").select("comp", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")),
            "parents",
        )
        discard(done)
        if parents.where("moved").isEmpty():
            return parents.select("comp", "parent")


def spanning_forest(links: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """((node, comp) of every node in a link, (u, v) of the forest's edges), both materialised.

    Links with a NULL end are left out; a link of a node to itself makes the
    node known and nothing else; repeats and directions don't matter. An empty
    table gives empty ones. Edges are ordered by their ends, which makes all
    weights different and rules out cycles.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ends = materialize(ends.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
    comps = materialize(ends.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("comp", F.col("node")), "comps")
    open_edges = ends.where("u <> v").select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv"))
    forest = ends.select("u", "v").where("false")
    for _ in range(MAX_ROUNDS):
        # each component's least edge out; both directions, summed up before the shuffle
        picked = materialize(
            open_edges.select(F.inline(F.array(
                F.struct(F.col("cu").alias("comp"), F.struct("u", "v", F.col("cv").alias("to")).alias("e")),
                F.struct(F.col("cv").alias("comp"), F.struct("u", "v", F.col("cu").alias("to")).alias("e")),
            ))).groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.*"),
            "picked",
        )
        if picked.isEmpty():
            discard(ends, open_edges, picked)
            return comps, materialize(forest.distinct(), "forest")
        forest = forest.unionByName(picked.select("u", "v"))
        # two components that pick the same edge would point at each other: the smaller is the root
        back = picked.select(F.col("comp").alias("to"), F.col("to").alias("back"))
        parents = picked.join(back, "to", "left").select(
            "comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("parent")
        )
        roots = _jump(materialize(parents, "parents"))
        old = comps
        comps = materialize(
            comps.join(roots, "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp")), "comps"
        )
        cu = comps.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
        cv = comps.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
        discard(old)
        edges = open_edges
        open_edges = materialize(edges.select("u", "v").join(cu, "u").join(cv, "v").where("cu <> cv").select("u", "v", "cu", "cv"), "edges")
        discard(edges)
    raise RuntimeError("components were left after the last round")


def rooted_forest(links: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """((code, person) of every code in a link, (u, v, person) of the forest's
    edges): the person is the root of the tree, its least code."""
    comps, forest = spanning_forest(links, a, b)
    least = comps.groupBy("comp").agg(F.min("node").alias("person"))
    codes = comps.join(least, "comp").select(F.col("node").alias("code"), "person")
    return codes, forest.join(codes.select(F.col("code").alias("u"), "person"), "u").select("u", "v", "person")


def grouped_codes(links: DataFrame, a: str, b: str) -> DataFrame:
    """(code, person): the least code among all codes linked directly or through others."""
    return rooted_forest(links, a, b)[0]


def with_person(rows: DataFrame, code: Column, links: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with ``patient_group`` (put in place of a column of that name); a
    code without a link stands for itself, a NULL code stays NULL."""
    people = grouped_codes(links, a, b).select(F.col("code").alias("__code"), F.col("person").alias("__person"))
    coded = rows.withColumn("__own", code)
    kept = [coded[c] for c in rows.columns if c != "patient_group"]
    return coded.join(people, F.col("__own") == F.col("__code"), "left").select(*kept, F.coalesce("__person", "__own").alias("patient_group"))


class _Deal:
    """The deal of one segment of groups, in STARTS orders at once.

    All orders keep the bands, largest first, and the strata within them
    together; they differ in which stratum of a band and which group of a
    stratum comes first, by a hash.
    """

    def __init__(self, shares: list[float], groups: list[tuple], starts: Sequence[int]):
        rows, bands, strata, hashes = (np.array(x) for x in zip(*groups))
        self.shares, self.rows = np.array(shares), rows.astype(np.float64)
        odd = np.array([2 * (s * 0x9E3779B97F4A7C15 % (1 << 63)) + 1 for s in starts], np.uint64)
        with np.errstate(over="ignore"):
            mixed = [(x.astype(np.int64).view(np.uint64)[None, :] * odd[:, None]) >> np.uint64(7) for x in (strata, hashes)]
        self.order = np.stack([np.lexsort((hashes, mixed[1][s], strata, mixed[0][s], -bands)) for s in range(len(starts))])

    def run(self, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(split of each group per order, how far each split is behind at the end)."""
        n_starts, n = self.order.shape
        behind = np.repeat(behind[None, :], n_starts, 0) if behind.ndim == 1 else behind.copy()
        out, each = np.empty((n_starts, n), np.int16), np.arange(n_starts)
        for i in range(n):
            at = self.order[:, i]
            size = self.rows[at]
            behind += size[:, None] * self.shares
            to = behind.argmax(1)
            behind[each, to] -= size
            out[each, at] = to
        return out, behind


def deal_splits(rows: DataFrame, group: str, traits: Sequence[Column], targets: list[tuple[str, float]], seed: int = 0, segment: int = SEGMENT) -> DataFrame:
    """(group, split_name): each group in one split, rows in the given shares.

    ``targets`` are (name, share), few. Groups are stratified by size band (rows
    to a power of two) and by the most frequent value of each trait, and dealt
    along the strata from the largest band down, each to the split furthest
    behind; so a group of a third of all rows comes first and all others make
    up for it, and the smallest come last. A segment of groups is one task's: the
    largest groups make the first, and what they leave uneven is carried to the
    others by their rows. STARTS orders within
    the strata are dealt, and the one is taken that leaves rows and traits
    nearest to their shares. This is the same for any number of groups.
    Rows with a NULL group stay together; an empty table gives no row; ties are
    ordered by a hash of the group's name, so the deal is the same every time.
    """
    total_share = sum(share for _, share in targets)
    if not targets or total_share <= 0 or any(share < 0 for _, share in targets):
        raise ValueError("targets need positive shares")
    shares = [share / total_share for _, share in targets]
    names = [f"_t{i}" for i in range(len(traits))]
    cells = rows.select(F.col(group).alias("_g"), *[t.cast("string").alias(n) for n, t in zip(names, traits)])
    counts = cells.groupBy("_g", *names).agg(F.count("*").alias("_n"))
    # the rows of a group by part of each trait's values
    part = lambda n: F.pmod(F.xxhash64(F.lit(n), F.coalesce(n, F.lit("\0"))), F.lit(TRAIT_PARTS)).cast("int")
    text = F.coalesce(F.col("_g").cast("string"), F.lit("\0"))
    keyed = materialize(
        counts.groupBy("_g").agg(
            F.sum("_n").alias("_rows"), *[F.max_by(n, F.struct("_n", F.coalesce(n, F.lit("")))).alias(n) for n in names],
            *[F.collect_list(F.struct(part(n).alias("p"), "_n")).alias(f"{n}p") for n in names])
        .select("_g", "_rows", F.floor(F.log2("_rows")).cast("int").alias("_band"),
                F.xxhash64(F.lit(seed), *names).alias("_stratum"), F.xxhash64(F.lit(seed), text).alias("_h"), *[f"{n}p" for n in names]),
        "groups",
    )
    n_groups, n_rows = keyed.agg(F.count("*"), F.sum("_rows")).first()
    spark = rows.sparkSession
    key_type = keyed.schema["_g"].dataType
    schema = T.StructType([T.StructField(group, key_type), T.StructField("split_name", T.StringType())])
    if not n_groups:
        return spark.createDataFrame([], schema)
    # segment 0: all groups if they are few, else the largest, of which there are no more than a segment takes
    others = 1 + F.pmod(F.xxhash64("_h", F.lit("segment")), F.lit(-(-n_groups // segment))).cast("int")
    number = F.lit(0) if n_groups <= segment else F.when(F.col("_rows") * segment >= n_rows, 0).otherwise(others)
    columns = keyed.withColumn("_segment", number).select("_g", "_rows", "_band", "_stratum", "_h", *[f"{n}p" for n in names], "_segment")
    first = columns.where("_segment = 0").coalesce(1)
    rest = columns.where("_segment > 0").repartition("_segment")
    rest_rows = (rest.agg(F.sum("_rows")).first()[0] or 0) if n_groups > segment else 0

    def segments(stream: Iterator[tuple]) -> Iterator[tuple[int, list[tuple]]]:
        held: dict[int, list[tuple]] = {}
        for r in stream:
            held.setdefault(r[-1], []).append(r)
        yield from sorted(held.items())

    k, n_traits = len(shares), len(names)

    out = T.StructType([T.StructField("behind", T.ArrayType(T.DoubleType())), T.StructField("got", T.ArrayType(T.DoubleType()))])

    def compared(part: DataFrame, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far behind each order leaves the splits, and the rows it gives them by trait part."""

        def compare(stream: Iterator[tuple]) -> Iterator[tuple]:
            for _, groups in segments(stream):
                share = sum(r[1] for r in groups) / (rest_rows or 1)
                to, behind = _Deal(shares, [r[1:5] for r in groups], range(1, STARTS + 1)).run(carried * share)
                got = np.zeros((n_traits, TRAIT_PARTS, STARTS, k))
                for t in range(n_traits):
                    for i, r in enumerate(groups):
                        for cell in r[5 + t]:
                            np.add.at(got[t, cell["p"]], (np.arange(STARTS), to[:, i]), cell["_n"])
                yield behind.ravel().tolist(), got.ravel().tolist()

        behind, got = np.zeros((STARTS, k)), np.zeros((n_traits, TRAIT_PARTS, STARTS, k))
        # one row per segment of groups, of a fixed size
        for r in map_partition(part, compare, out, 1).toLocalIterator():
            behind += np.array(r["behind"]).reshape(behind.shape)
            got += np.array(r["got"]).reshape(got.shape)
        return behind, got

    carried, got = compared(first, np.zeros((STARTS, k)))
    behind = carried
    if rest_rows:
        behind, more = compared(rest, carried)
        got = got + more
    wanted = got.sum(3, keepdims=True) * np.array(shares)
    off = ROW_WEIGHT * (behind**2).sum(1) + ((got - wanted) ** 2).sum((0, 1, 3)) / max(1, n_traits)
    best = int(off.argmin())
    start = carried[best]

    def deal(stream: Iterator[tuple]) -> Iterator[tuple]:
        for number, groups in segments(stream):
            share = sum(r[1] for r in groups) / (rest_rows or 1) if number else 0.0
            to, _ = _Deal(shares, [r[1:5] for r in groups], [best + 1]).run(start * share)
            for r, split in zip(groups, to[0].tolist()):
                yield r[0], targets[split][0]

    return materialize(map_partition(first, deal, schema).unionByName(map_partition(rest, deal, schema)), "splits")
