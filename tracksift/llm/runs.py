"""Runs of near-identical consecutive events, by optimal segmentation.

Every event has a dissimilarity to each label of a vocabulary (the slips of
the pen between its words and the label's spellings). A segmentation costs the
dissimilarity of its events to their segment's label plus a penalty per
boundary; the least is found by dynamic programming over the labels. A label
that costs more than the best one and a boundary is pruned to that sum, which
leaves few different states, so a step is looked up once it has been made; and
as soon as all labels go back to one, what lies before is settled and given out.

Sequences are range-partitioned by entity and order, so one entity with a third
of all rows is spread over many tasks. What a partition can't settle at its
borders it gives out once for each label its first or last event may have,
with the cost; the labels at the borders are then chosen by the same programme
over the partitions' costs, so the result doesn't depend on where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition
from tracksift.session import materialize, shuffle_parts

#: Cost of a boundary; dissimilarities lie between 0 and 1 and are kept in millionths.
PENALTY, SCALE = 0.04, 1_000_000
#: States whose steps a task keeps at hand.
KEPT_STATES = 50_000


def slips(a: str, b: str) -> int:
    """Edits between two words: letters dropped, added, changed, or neighbours swapped."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


class Vocabulary:
    """Labels with their spellings. ``distances(text)`` gives the dissimilarity
    to each label in millionths, or None if no word of the text is within ``max_slips`` of a
    spelling (half as many, rounded down, for words of up to four letters)."""

    def __init__(self, spellings: dict[str, list[str]], max_slips: int = 1):
        self.labels = list(spellings)
        self.words = [(w, k) for k, label in enumerate(self.labels) for w in spellings[label]]
        self.max_slips = max_slips
        self.distances = lru_cache(maxsize=100_000)(self._distances)

    def _distances(self, text: str | None) -> tuple[int, ...] | None:
        tokens = re.findall(r"[a-z]+", (text or "").lower())
        best, named = [1.0] * len(self.labels), None
        for token in tokens:
            for word, k in self.words:
                if abs(len(word) - len(token)) > self.max_slips + 2:
                    continue
                n = slips(token, word)
                if n <= (self.max_slips if len(word) > 4 else self.max_slips // 2) and (named is None or n < named):
                    named = n
                best[k] = min(best[k], n / max(len(word), len(token)))
        return None if named is None else tuple(round(x * SCALE) for x in best)


class Steps:
    """The programme's steps. A state holds what each label costs above the best."""

    def __init__(self, penalty: float):
        self.penalty = round(penalty * SCALE)
        self.made: dict[tuple, dict[tuple, tuple]] = {}

    def first(self, costs: tuple[int, ...], label: int | None = None) -> tuple[int, tuple]:
        """(cost, state) after one event, which has ``label`` if that is given."""
        low = min(costs) if label is None else costs[label]
        far = 4 * SCALE * len(costs) + 4 * self.penalty  # out of reach, whatever follows
        return low, tuple(c - low if label in (None, k) else far for k, c in enumerate(costs))

    def next(self, state: tuple, costs: tuple[int, ...]) -> tuple[int, tuple, tuple, int | None]:
        """(added cost, state, the label before for each label now, that label if it is one for all)."""
        made = self.made.get(state)
        if made is None:
            if len(self.made) > KEPT_STATES:
                self.made.clear()
            made = self.made[state] = {}
        step = made.get(costs)
        if step is None:
            low = min(range(len(state)), key=lambda k: (state[k], k))
            # ties stay; state[low] is 0
            came = tuple(k if x <= self.penalty else low for k, x in enumerate(state))
            totals = [min(x, self.penalty) + c for x, c in zip(state, costs)]
            least = min(totals)
            step = made[costs] = (least, tuple(x - least for x in totals), came, came[0] if len(set(came)) == 1 else None)
        return step


def _back(pending: list[tuple], end: int) -> list[int]:
    """Labels of the pending events but the last, and ``end``, which it has."""
    out = [end]
    for came in reversed(pending):
        out.append(came[out[-1]])
    return out[::-1]


def segment(costs: list[tuple[int, ...]], penalty: float) -> list[int]:
    """The label of each event in the cheapest segmentation."""
    if not costs:
        return []
    steps = Steps(penalty)
    _, state = steps.first(costs[0])
    pending = []
    for c in costs[1:]:
        _, state, came, _ = steps.next(state, c)
        pending.append(came)
    return _back(pending, state.index(0))


class Run:
    """Label, first and last (at, key), number of events."""

    __slots__ = ("label", "first", "last", "n")

    def __init__(self, label: int, event: tuple, last: tuple | None = None, n: int = 1):
        self.label, self.first, self.last, self.n = label, event, last or event, n


def extended(runs: list[Run], labels: list[int], events: list[tuple]) -> list[Run]:
    """``runs`` with events added at the end; the last run is copied, not changed."""
    out = list(runs)
    if out:
        r = out[-1]
        out[-1] = Run(r.label, r.first, r.last, r.n)
    for label, e in zip(labels, events):
        if out and out[-1].label == label:
            out[-1].last = e
            out[-1].n += 1
        else:
            out.append(Run(label, e))
    return out


class Stretch:
    """The events of one entity in one partition.

    ``heads`` is what isn't settled at the front: for each label of the first
    event its cost and runs, of which the last is still open. It has one entry,
    under -1, where the first event is free, and is given out when a run after
    it begins, so that no later event matters to it.
    """

    def __init__(self, steps: Steps, event: tuple, costs: tuple[int, ...], leads: bool):
        self.steps = steps
        self.paths = {a: (*steps.first(costs, None if a < 0 else a), []) for a in (range(len(costs)) if leads else (-1,))}
        self.events = [event]
        self.heads: dict[int, tuple[int, list[Run]]] = {a: (0, []) for a in self.paths}
        self.joined = not leads  # one path for all labels of the first event
        self.cost = 0  # since the paths joined

    def add(self, event: tuple, costs: tuple[int, ...]) -> list[tuple[int, list[Run]]]:
        """Takes an event; (label of the first event or -1, runs) that it settles."""
        if len(self.events) == 1 and (head := self.heads.get(-1)) and self.joined:
            # one path, one head, one event that isn't settled: the usual case
            path = self.paths[-1]
            _, state, came, end = self.steps.next(path[1], costs)
            if end is not None:
                runs, before = head[1], self.events[0]
                self.paths[-1] = (0, state, path[2])
                self.events[0] = event
                if runs and runs[-1].label == end:
                    runs[-1].last = before
                    runs[-1].n += 1
                    return []
                closed = runs[:]
                runs[:] = [Run(end, before)]
                return [(-1, closed)] if closed else []
        ends, states = set(), set()
        for a, (cost, state, pending) in self.paths.items():
            more, state, came, end = self.steps.next(state, costs)
            pending.append(came)
            self.paths[a] = (cost + more, state, pending)
            ends.add(end)
            states.add(state)
        done: list[tuple[int, list[Run]]] = []
        if len(ends) == 1 and len(states) == 1 and (end := ends.pop()) is not None:
            if not self.joined:
                self.heads = {a: (cost, extended([], _back(pending[:-1], end), self.events)) for a, (cost, _, pending) in self.paths.items()}
                self.joined = True
            else:
                (_, _, pending), = self.paths.values()
                labels = _back(pending[:-1], end)
                for a, (cost, runs) in self.heads.items():
                    self.heads[a] = (cost, extended(runs, labels, self.events))
            self.paths = {-1: (0, states.pop(), [])}
            done = self._settled()
            self.events = []
        self.events.append(event)
        return done

    def _settled(self) -> list[tuple[int, list[Run]]]:
        """Closed runs; those of all heads alike once a run has begun after each."""
        last = next(iter(self.heads.values()))[1][-1]
        if not all(len(r) > 1 and r[-1].first == last.first and r[-1].label == last.label for _, r in self.heads.values()):
            return []
        out = [(a, runs[:-1]) for a, (_, runs) in self.heads.items()]
        self.costs = getattr(self, "costs", None) or ({a: c for a, (c, _) in self.heads.items()} if -1 not in self.heads else None)
        self.heads = {-1: (0, [last])}
        return out

    def close(self, trails: bool) -> tuple[list[tuple[int, int, list[Run]]], dict[tuple[int, int], int]]:
        """(label of the first event or -1, of the last or -1, runs) of the rest, and
        what each pair of labels costs in all; -1 stands for one that is free."""
        rows, costs = [], {}
        front = getattr(self, "costs", None) or {}
        for p, (more, state, pending) in self.paths.items():
            ends = range(len(state)) if trails else (state.index(0),)
            for b in ends:
                labels = _back(pending, b)
                for a, (cost, runs) in self.heads.items():
                    if p not in (-1, a):
                        continue
                    mark = b if trails else -1
                    rows.append((a, mark, extended(runs, labels, self.events)))
                    for first in front if a < 0 and front else (a,):
                        costs[first, mark] = front.get(first, cost) + more + state[b]
        return rows, costs


def label_runs(
    df: DataFrame, entity: list[str], at: str, key: str, text: str, vocabulary: Callable[[], Vocabulary], penalty: float = PENALTY,
) -> DataFrame:
    """Rows (``*entity``, label, first_key, last_key, first_at, last_at, n_events), one per run.

    Events of an entity are ordered by ``at`` (seconds), ties by ``key`` (a
    unique integer); an event delivered twice counts once. Events with a NULL
    entity, time or key, and those whose text names no label, are passed over.
    Runs of one event are given too. An empty table gives no row; columns
    beyond those named are ignored. Of several segmentations that cost the same
    one is given.
    """
    names = [f"_e{i}" for i in range(len(entity))]
    rows = df.select(
        *[df[c].alias(a) for c, a in zip(entity, names)], df[at].cast("double").alias("_t"), df[key].cast("bigint").alias("_k"), df[text].alias("_x")
    )
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in [*names, "_t", "_k", "_x"]) + " AND NOT isnan(_t)")
    order = [*names, "_t", "_k"]
    parts = shuffle_parts(df.sparkSession)
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType(
        [T.StructField(a, df.schema[c].dataType) for c, a in zip(entity, names)]
        + [T.StructField("label", T.StringType()), T.StructField("first_key", T.LongType()), T.StructField("last_key", T.LongType()),
           T.StructField("first_at", T.DoubleType()), T.StructField("last_at", T.DoubleType()), T.StructField("n_events", T.LongType()),
           T.StructField("_part", T.IntegerType()), T.StructField("_place", T.IntegerType()), T.StructField("_a", T.IntegerType()),
           T.StructField("_b", T.IntegerType()), T.StructField("_edge", T.BooleanType()), T.StructField("_cost", T.LongType())]
    )
    n_keys = len(names)

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        vocab, part, steps = vocabulary(), TaskContext.get().partitionId(), Steps(penalty)
        who, seen, stretch, place = None, None, None, 0

        def rows(a: int, b: int, runs: list[Run], opens: bool, closes: bool) -> Iterator[tuple]:
            for i, r in enumerate(runs):
                edge = opens and i == 0 or closes and i == len(runs) - 1
                yield (*who, vocab.labels[r.label], r.first[1], r.last[1], r.first[0], r.last[0], r.n, part, place, a, b, edge, None)

        def closed(trails: bool) -> Iterator[tuple]:
            rest, costs = stretch.close(trails)
            for a, b, runs in rest:
                yield from rows(a, b, runs, place == 0 and fresh, trails)
            if place == 0 or trails:
                for (a, b), cost in costs.items():
                    yield (*who, None, None, None, None, None, None, part, place, a, b, True, cost)

        fresh = True  # nothing of the partition's first entity has been given out
        for row in stream:
            if row == seen:
                continue
            seen = row
            costs = vocab.distances(row[n_keys + 2])
            if costs is None:
                continue
            event = row[n_keys : n_keys + 2]
            if row[:n_keys] != who:
                if stretch:
                    yield from closed(False)
                    place += 1
                who, fresh = row[:n_keys], place == 0
                stretch = Stretch(steps, event, costs, place == 0)
                continue
            done = stretch.add(event, costs)
            for a, runs in done:
                yield from rows(a, -1, runs, place == 0 and fresh, False)
            fresh = fresh and not done
        if stretch:
            yield from closed(True)

    found = materialize(map_partition(ordered, run, schema), "runs")
    # a few rows per partition: safe on the driver, whose number of partitions bounds them
    chosen = _choose([tuple(r) for r in found.where("_cost IS NOT NULL").select("_part", "_place", *names, "_a", "_b", "_cost").collect()], round(penalty * SCALE))
    mine = found.where("_cost IS NULL")
    keep = df.sparkSession.createDataFrame(chosen, "_p int, _q int, _ca int, _cb int")
    marked = mine.where("_a >= 0 OR _b >= 0").join(F.broadcast(keep), (F.col("_part") == F.col("_p")) & (F.col("_place") == F.col("_q")))
    kept = marked.where("_a IN (-1, _ca) AND _b IN (-1, _cb)").select(*mine.columns).unionByName(mine.where("_a < 0 AND _b < 0"))
    out_columns = mine.columns[: n_keys + 6]
    inner = kept.where("NOT _edge").select(*out_columns)
    edges = sorted((tuple(r) for r in kept.where("_edge").collect()), key=lambda r: (r[n_keys + 6], r[n_keys + 7], r[n_keys + 3], r[n_keys + 1]))
    joined: list[list] = []
    before = None
    for r in edges:
        row, part = list(r[: n_keys + 6]), r[n_keys + 6]
        if joined and before != part and joined[-1][: n_keys + 1] == row[: n_keys + 1]:
            last = joined[-1]
            last[n_keys + 2], last[n_keys + 4] = row[n_keys + 2], row[n_keys + 4]
            last[n_keys + 5] += row[n_keys + 5]
        else:
            joined.append(row)
        before = part
    stitched = df.sparkSession.createDataFrame(joined, inner.schema)
    out = inner.unionByName(stitched)
    return out.select(*[out[a].alias(c) for c, a in zip(entity, names)], *out.columns[n_keys:])


def _choose(costs: list[tuple], penalty: int) -> list[tuple[int, int, int, int]]:
    """(part, place, label of the first event or -1, of the last or -1) that make
    the whole cheapest. ``costs`` has part, place, entity ..., the two labels and
    the cost; stretches of one entity at the end of a partition and the
    beginning of the next are one chain."""
    table: dict[tuple[int, int], tuple[tuple, dict]] = {}
    for part, place, *who, a, b, cost in costs:
        table.setdefault((part, place), (tuple(who), {}))[1][a, b] = cost
    chains: list[list[tuple[int, int]]] = []
    for at in sorted(table):
        who, pairs = table[at]
        goes_on = chains and table[chains[-1][-1]][0] == who and chains[-1][-1][0] != at[0] and at[1] == 0
        if goes_on:
            chains[-1].append(at)
        else:
            chains.append([at])
    out = []
    for chain in chains:
        # best[b]: least cost up to here with b last; back: the pairs that give it
        best: dict[int, int] = {}
        back: list[dict[int, tuple[int, int]]] = []
        for i, at in enumerate(chain):
            now: dict[int, int] = {}
            links: dict[int, tuple[int, int]] = {}
            for (a, b), cost in sorted(table[at][1].items()):
                if i:
                    prev = min(best, key=lambda x: (best[x] + penalty * (x != a), x != a, x))
                    total = best[prev] + penalty * (prev != a) + cost
                else:
                    prev, total = -1, cost
                if b not in now or total < now[b]:
                    now[b], links[b] = total, (prev, a)
            best = now
            back.append(links)
        b = min(best, key=lambda x: (best[x], x))
        for at, links in zip(reversed(chain), reversed(back)):
            prev, a = links[b]
            out.append((*at, a, b))
            b = prev
    return out
