"""Boxes and points as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop_box(x: Column, y: Column, width: Column, height: Column, side: int = 224) -> Column:
    """struct<x1, y1, x2, y2> of a square around a point, shifted to lie inside the
    picture; a picture smaller than the square is taken whole in that direction."""

    def one(c: Column, size: Column) -> tuple[Column, Column]:
        lo = F.greatest(F.least(c - side / 2.0, size - side), F.lit(0.0))
        return lo, F.least(lo + side, size)

    (x1, x2), (y1, y2) = one(x, width.cast("double")), one(y, height.cast("double"))
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def extended_point(elbow: Column, wrist: Column, ratio: float, size: Column) -> Column:
    """A coordinate beyond the wrist on the line from the elbow, clamped to the picture; NULL stays NULL."""
    return F.greatest(F.least(elbow + (wrist - elbow) * (1.0 + ratio), size.cast("double")), F.lit(0.0))


def capped_frames(n: Column, fps: Column, target: float, most: int) -> Column:
    """Frames every fps/target, at most ``most``, thinned evenly beyond, the last frame always among them."""
    step = F.greatest(F.floor(fps / target), F.lit(1))
    every = F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)), step.cast("bigint"))
    spread = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint")), lambda i: F.floor(i * (n - 1) / (most - 1)))
    few = F.array_distinct(F.concat(every, F.array(F.greatest(n - 1, F.lit(0)))))
    return F.when(F.floor((n - 1) / step) + 2 > most, spread).otherwise(few)


def nearest(point: list[Column], centres: Column, names: list[str]) -> Column:
    """The id of the centre with the least squared distance; ``centres`` is an array of
    structs (id, *names), a few that ride along in the row."""
    off = lambda c: sum(((p - c[n]) * (p - c[n]) for p, n in zip(point, names)), F.lit(0.0))
    return F.array_min(F.transform(centres, lambda c: F.struct(off(c).alias("d"), c["id"].alias("id"))))["id"]


def hand_point(elbow: Column, wrist: Column, ratio: float, width: Column, height: Column) -> Column:
    """struct<x, y, conf> of a hand beyond the wrist on the line from the elbow (structs
    of x, y, conf): whole pixels inside the picture, as sure as the less sure end. If
    either has a part that is NULL or NaN, NaN with confidence 0."""
    parts = [p[n].cast("double") for p in (elbow, wrist) for n in ("x", "y", "conf")]
    known = parts[0].isNotNull()
    for c in parts:
        known = known & c.isNotNull() & ~F.isnan(c)
    at = lambda n, size: F.greatest(F.least(F.bround(elbow[n] + (wrist[n] - elbow[n]) * (1.0 + ratio)), size - 1.0), F.lit(0.0))
    nan = F.lit(float("nan"))
    return F.when(known, F.struct(at("x", width).alias("x"), at("y", height).alias("y"), F.least(elbow["conf"], wrist["conf"]).cast("double").alias("conf"))).otherwise(
        F.struct(nan.alias("x"), nan.alias("y"), F.lit(0.0).alias("conf")))


def crop_plan(points: Column, width: Column, height: Column, mode: str = "middle", side: int = 224, sure: float = 0.5, fast: float = 50.0, least_frames: int = 4) -> Column:
    """struct<status, boxes> of a window's frames, whose hands are array<struct<x, y, conf>>.

    The square lies round the middle of first and last hand (``middle``), goes
    straight from the first to the last (``linear``), round each frame's own
    (``individual``), or is the first where the hand is slow and the second where
    it is fast (``mixed``). Status is ``ABSTAIN`` with whole pictures where a hand
    that is needed isn't ``sure``, else ``FAST`` (the larger coordinate moved ``fast``
    per frame, over ``least_frames`` or more) or ``OK``.
    """
    if mode not in ("middle", "linear", "individual", "mixed"):
        raise ValueError(f"no crop mode {mode}")
    half, n = side // 2, F.size(points)
    first, last = F.get(points, 0), F.get(points, n - 1)

    def box(x: Column, y: Column) -> Column:
        def one(c: Column, size: Column) -> tuple[Column, Column]:
            mid = F.bround(F.greatest(F.lit(float(half)), F.least(size - half, c)))
            return F.greatest(mid - half, F.lit(0.0)).cast("int"), F.least(mid + half, size.cast("double")).cast("int")

        (x1, x2), (y1, y2) = one(x, width), one(y, height)
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    whole = F.transform(points, lambda _: F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), width.cast("int").alias("x2"), height.cast("int").alias("y2")))
    moved = F.greatest(F.abs(last["x"] - first["x"]), F.abs(last["y"] - first["y"])) >= fast * (n - 1)
    quick = moved & (n >= least_frames)
    middle = F.transform(points, lambda _: box((first["x"] + last["x"]) / 2.0, (first["y"] + last["y"]) / 2.0))
    share = lambda i: F.when(n > 1, i / (n - 1)).otherwise(0.0)
    linear = F.transform(points, lambda _, i: box((1 - share(i)) * first["x"] + share(i) * last["x"], (1 - share(i)) * first["y"] + share(i) * last["y"]))
    own = F.transform(points, lambda p: box(p["x"], p["y"]))
    boxes = {"middle": middle, "linear": linear, "individual": own, "mixed": F.when(quick, linear).otherwise(middle)}[mode]
    needed = F.forall(points, lambda p: p["conf"] >= sure) if mode == "individual" else (first["conf"] >= sure) & (last["conf"] >= sure)
    seen = F.coalesce(needed, F.lit(False))
    return F.struct(F.when(~seen, "ABSTAIN").when(F.coalesce(quick, F.lit(False)), "FAST").otherwise("OK").alias("status"), F.when(seen, boxes).otherwise(whole).alias("boxes"))
