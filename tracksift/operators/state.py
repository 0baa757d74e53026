"""Keyed state: flags over ordered rows, smoothing passes and box tracking.

What a state needs to know of the rows before is put into running windows;
only trackers run per entity over Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition
from tracksift.session import materialize


def two_flag_states(df: DataFrame, keys: list[str], order: list[str], when_off: dict[str, Column], when_on: dict[str, Column]) -> DataFrame:
    """Rows (keys, *order, *flags): per flag the state after each row.

    ``when_off`` and ``when_on`` give, per flag, the answer to the question that
    is asked while the flag is off (does it start?) and on (does it end?), of
    which only the one the state asks for counts. A row where just one answer is
    yes sets the state whatever it was, one with two yeses turns it over, one
    with none leaves it: the state is that of the last row that set it, turned
    over as often as rows since do, which running windows give. A NULL answer
    is a no; ties in ``order`` are in an arbitrary order.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df
    for f in when_off:
        starts, ends = F.coalesce(when_off[f], F.lit(False)), F.coalesce(when_on[f], F.lit(False))
        rows = rows.withColumn(f"__s_{f}", F.when(starts != ends, starts)).withColumn(f"__t_{f}", (starts & ends).cast("int"))
    for f in when_off:
        turns = F.sum(f"__t_{f}").over(w)
        rows = rows.withColumn(f"__n_{f}", turns)
    states = []
    for f in when_off:
        at_set = F.when(F.col(f"__s_{f}").isNotNull(), F.struct(F.col(f"__s_{f}").alias("on"), F.col(f"__n_{f}").alias("n")))
        last = F.last(at_set, ignorenulls=True).over(w)
        since = F.col(f"__n_{f}") - F.coalesce(last["n"], F.lit(0))
        states.append((F.coalesce(last["on"], F.lit(False)) != (since % 2 == 1)).alias(f))
    return rows.select(*keys, *order, *states)


def fill_windows(frames: DataFrame, key: str, label: str, element: str, width: int) -> DataFrame:
    """``frames`` (with ``_pos`` from 0) with the windows of ``width`` frames that lie
    between windows beginning with ``element`` given to it whole, and a part
    window at the end given to it after one that does.

    A window only counts by its first frame, so the rule runs on a table of
    window heads. Filling one window can matter to the next only where that
    begins with the element itself, hence two windows back are looked at and
    nothing has to be done one after the other.
    """
    at = F.floor(F.col("_pos") / width)
    heads = frames.where(F.col("_pos") % width == 0).select(
        F.col(key).alias("_hk"), at.alias("_win"), F.coalesce(F.col(label) == element, F.lit(False)).alias("_is"))
    sizes = frames.groupBy(F.col(key).alias("_hk"), at.alias("_win")).agg(F.count("*").alias("_size"))
    w = Window.partitionBy("_hk").orderBy("_win")
    near = lambda n: F.coalesce((F.lag("_is", -n) if n < 0 else F.lead("_is", n)).over(w), F.lit(False))
    before = F.lag("_is", 1).over(w)
    came = F.coalesce(before, F.lit(False)) | (F.col("_is") & F.coalesce(F.lag("_is", 2).over(w), F.lit(False)) & before.isNotNull())
    marks = heads.join(sizes, ["_hk", "_win"]).select(
        "_hk", "_win", "_size", "_is", (near(1) & came).alias("_mid"), before.isNotNull().alias("_second"), came.alias("_came"))
    # the head before a part window, after the windows before it were filled
    held = F.lag(F.col("_is") | F.col("_mid"), 1).over(w)
    filled = marks.select("_hk", F.col("_win").alias("_fw"), F.when(F.col("_size") < width, F.coalesce(held, F.lit(False))).otherwise(F.col("_mid") & F.col("_second")).alias("_fill"))
    joined = frames.withColumn("_win", at).join(filled, (F.col(key) == F.col("_hk")) & (F.col("_win") == F.col("_fw")))
    return joined.select(*[F.when(F.col("_fill"), F.lit(element)).otherwise(F.col(c)).alias(c) if c == label else c for c in frames.columns])


def open_turns(frames: DataFrame, key: str, label: str, half: int, turns: dict[tuple[str, str], str]) -> DataFrame:
    """``frames`` (with ``_pos``) with direct turns opened up by ``half`` frames to each
    side: ``turns`` maps (before, after) to the label put there.

    A turn within the frames that an earlier one opened up is none any more.
    That choice goes from turn to turn, with one number of state, over the rows
    of the turns alone; a frame takes the latest turn that reaches it.
    """
    w = Window.partitionBy(key).orderBy("_pos")
    before = F.lag(label).over(w)
    to = F.coalesce(*[F.when((before == a) & (F.col(label) == b), F.lit(c)) for (a, b), c in turns.items()])
    found = frames.withColumn("_to", to).where("_to IS NOT NULL").select(key, "_pos", "_to")

    def choose(rows: Iterator[tuple]) -> Iterator[tuple]:
        who, last = None, 0
        for k, pos, named in rows:
            if k != who or pos > last + half:
                who, last = k, pos
                yield k, pos, named

    kept = map_partition(found.repartition(key).sortWithinPartitions(key, "_pos"), choose, found.schema)
    reach = kept.select(F.col(key).alias("_hk"), F.explode(F.sequence(F.col("_pos") - half, F.col("_pos") + (half - 1))).alias("_at"), F.col("_pos").alias("_turn"), "_to")
    latest = reach.groupBy("_hk", "_at").agg(F.max_by("_to", "_turn").alias("_to"))
    joined = frames.join(latest, (F.col(key) == F.col("_hk")) & (F.col("_pos") == F.col("_at")), "left")
    return joined.select(*[F.coalesce("_to", label).alias(c) if c == label else c for c in frames.columns])


def smooth(df: DataFrame, key: str, order: list[str], label: str, elements: list[str], width: int) -> DataFrame:
    """(key, *order, label): ``fill_windows`` for each element in turn, then turns
    between idle and transport opened up as reach and reposition.

    Rows with a NULL key are left out; an empty table gives no row.
    """
    if width < 2:
        raise ValueError("a window has two frames at least")
    frames = df.where(F.col(key).isNotNull()).select(key, *order, label, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("bigint").alias("_pos"))
    for e in elements:
        frames = materialize(fill_windows(frames, key, label, e, width), "frames")
    out = open_turns(frames, key, label, width // 2, {("idle", "transport"): "reach", ("transport", "idle"): "reposition"})
    return out.select(key, *order, label)


def hold_stabilize(df: DataFrame, key: str, order: list[str], label: str, holding: str, steady: str, width: int) -> DataFrame:
    """(key, *order, label): stretches of ``steady`` frames within stretches of
    ``holding`` frames, both booleans, brought into the labels as ``stabilize``.

    A steady stretch of two windows or more is taken as it is. A shorter one that
    ends at most three windows before the hold does turns the hold's last window
    into ``stabilize``, and with it what lies between the last stretch taken
    before and that window if it is less than a window. What reaches before the
    first frame is cut off; NULL flags are false.
    """
    w = Window.partitionBy(key).orderBy(*order)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = df.where(F.col(key).isNotNull()).select(key, *order, label, (F.row_number().over(w) - 1).cast("bigint").alias("_pos"), flag(holding).alias("_h"), (flag(holding) & flag(steady)).alias("_s"))
    frames = materialize(rows, "frames")
    by = Window.partitionBy(key).orderBy("_pos")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    start = lambda c: (F.col(c) & ~F.coalesce(F.lag(c).over(by), F.lit(False))).cast("int")
    runs = frames.select(key, "_pos", "_h", "_s", start("_h").alias("_nh"), start("_s").alias("_ns")).where("_h").select(
        key, "_pos", "_s", F.sum("_nh").over(upto).alias("_hold"), F.sum("_ns").over(upto).alias("_run"))
    ends = runs.groupBy(key, "_hold").agg((F.max("_pos") + 1).alias("_end"))
    parts = runs.where("_s").groupBy(key, "_hold", "_run").agg(F.min("_pos").alias("_a"), (F.max("_pos") + 1).alias("_b")).join(ends, [key, "_hold"])
    long = F.col("_b") - F.col("_a") >= 2 * width
    earlier = Window.partitionBy(key, "_hold").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(long, F.col("_b")), ignorenulls=True).over(earlier)
    last = F.col("_end") - width
    spans = parts.select(key, F.when(long, F.col("_a")).when(last - seen < width, F.least(seen, last)).otherwise(last).alias("_from"),
                         F.when(long, F.col("_b")).otherwise(F.col("_end")).alias("_upto"), (long | (F.col("_end") - F.col("_b") <= 3 * width)).alias("_take")).where("_take")
    hit = spans.select(F.col(key).alias("_hk"), F.explode(F.sequence(F.greatest("_from", F.lit(0)), F.col("_upto") - 1)).alias("_at")).distinct()
    joined = frames.join(hit, (F.col(key) == F.col("_hk")) & (F.col("_pos") == F.col("_at")), "left")
    return joined.select(key, *order, F.when(F.col("_at").isNotNull(), F.lit("stabilize")).otherwise(F.col(label)).alias(label))


def box_iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


class Tracker:
    """Tracks of one video: each box takes the best free track it overlaps by
    ``least`` or more, else a new one; tracks unseen for over ``max_age`` frames end."""

    def __init__(self, least: float = 0.3, max_age: int = 30):
        self.least, self.max_age, self.next_id = least, max_age, 1
        self.tracks: dict[int, list] = {}

    def frame(self, boxes: list[tuple]) -> list[int]:
        free, ids = list(self.tracks), []
        for box in boxes:
            scored = [(box_iou(box, self.tracks[t][0]), -n, t) for n, t in enumerate(free)]
            best = max(scored, default=(0.0, 0, 0))
            if best[0] >= self.least and best[2]:
                track = best[2]
                free.remove(track)
            else:
                track, self.next_id = self.next_id, self.next_id + 1
            self.tracks[track] = [box, 0]
            ids.append(track)
        for t in free:
            self.tracks[t][1] += 1
            if self.tracks[t][1] > self.max_age:
                del self.tracks[t]
        return ids


def _frames(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, frame, rows of the frame) of rows sorted by key and frame."""
    at, held = None, []
    for r in rows:
        if r[:2] != at:
            if held:
                yield *at, held
            at, held = r[:2], []
        held.append(r)
    if held:
        yield *at, held


def track_boxes(df: DataFrame, key: str, least: float = 0.3, max_age: int = 30) -> DataFrame:
    """(key, frame, box, track): ``df`` has frame, box, x1, y1, x2, y2, boxes in order
    of ``box`` within a frame; frames without boxes age the tracks by their number.

    Videos stream through their tasks frame by frame; what is held is one frame
    and the open tracks.
    """
    schema = T.StructType([df.schema[key]] + [T.StructField(c, T.LongType()) for c in ("frame", "box", "track")])
    parted = df.select(key, F.col("frame").cast("bigint"), F.col("box").cast("bigint"), *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    parted = parted.repartition(key).sortWithinPartitions(key, "frame", "box")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        who, tracker, last = None, Tracker(least, max_age), None
        for k, frame, boxes in _frames(rows):
            if last is None or k != who:
                who, tracker, last = k, Tracker(least, max_age), frame - 1
            for _ in range(min(frame - last - 1, max_age + 1)):
                tracker.frame([])
            for r, track in zip(boxes, tracker.frame([r[3:] for r in boxes])):
                yield k, frame, r[2], track
            last = frame

    return map_partition(parted, run, schema)


def bind_slots(df: DataFrame, key: str, anchors: list[tuple], least: float = 0.3) -> DataFrame:
    """(key, frame, slot, box): which box of a frame fills each of a few slots.

    A slot with an anchor (x1, y1, x2, y2; None: without) takes the free box that
    overlaps it most, if by ``least``; the slots still empty then take, in order,
    the free box that overlaps most what they held last. A slot that finds none
    keeps what it held last and has no row for that frame.
    """
    schema = T.StructType([df.schema[key]] + [T.StructField(c, T.LongType()) for c in ("frame", "slot", "box")])
    parted = df.select(key, F.col("frame").cast("bigint"), F.col("box").cast("bigint"), *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    parted = parted.repartition(key).sortWithinPartitions(key, "frame", "box")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        who, held = None, {}
        for k, frame, boxes in _frames(rows):
            if k != who:
                who, held = k, {}
            free, filled = {r[2]: r[3:] for r in boxes}, {}
            for wanted in (dict(enumerate(anchors)), held):
                for slot in range(len(anchors)):
                    at = wanted.get(slot)
                    if slot in filled or at is None or not free:
                        continue
                    box = max(free, key=lambda b: (box_iou(at, free[b]), -b))
                    if box_iou(at, free[box]) >= least:
                        filled[slot] = (box, free.pop(box))
            for slot, (box, place) in sorted(filled.items()):
                held[slot] = place
                yield k, frame, slot, box

    return map_partition(parted, run, schema)
