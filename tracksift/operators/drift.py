"""Schemas that drift between the files of a series: one table, all changes.

Every field of every file is profiled (type, and a sketch of its value: the
number it carries and the shape of what is around it). Presence is compared with the preceding file of the same
series and task through running file positions; what goes and what comes in the
same file is matched as a bipartite graph whose edges need the same type and a
number within two percent and are weighted by the likeness of names, numbers
and shapes. Matched pairs are renames; the unified table carries every value
under the name its field bore first.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition
from tracksift.operators.matching import best_matching
from tracksift.operators.nested import value_type
from tracksift.operators.ranks import running_total
from tracksift.session import materialize

#: Two numbers count as the same up to this share of the larger.
NUMBER_TOLERANCE = 0.02
#: What an equal shape adds to the likeness of a pair, whose names and numbers give 1 at most.
SHAPE = 0.05

PROFILE = T.StructType([
    T.StructField("series", T.StringType()), T.StructField("written_at", T.TimestampNTZType()),
    T.StructField("run_no", T.LongType()), T.StructField("task", T.StringType()),
    T.StructField("fields", T.ArrayType(T.StructType([
        T.StructField("field", T.StringType()), T.StructField("value_type", T.StringType()),
        T.StructField("number", T.DoubleType()), T.StructField("shape", T.StringType()), T.StructField("text", T.StringType()),
    ]))),
])

CHANGES = T.StructType([
    T.StructField("series", T.StringType()), T.StructField("task", T.StringType()), T.StructField("file_pos", T.LongType()),
    T.StructField("run_no", T.LongType()), T.StructField("change_kind", T.StringType()),
    T.StructField("old_field", T.StringType()), T.StructField("new_field", T.StringType()),
])


def number_in(v: Any) -> float | None:
    """The one number a value carries, bare or inside a string, list or object."""
    if v is None or isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, str):
        try:
            x = float(v.strip())
        except ValueError:
            return None
        return x if x == x and abs(x) != float("inf") else None
    inner = [x for x in map(number_in, v.values() if isinstance(v, dict) else v) if x is not None]
    return inner[0] if len(inner) == 1 else None


def same_number(a: float | None, b: float | None) -> bool:
    return a is not None and b is not None and abs(a - b) <= NUMBER_TOLERANCE * max(abs(a), abs(b))


def shape_of(v: Any, depth: int = 3) -> str:
    """What is around the number of a value: the words of a text, the kinds in a
    list, the keys of an object, down to ``depth``."""
    if isinstance(v, str):
        return "s:" + " ".join(re.findall(r"[^\W\d_]+", v)[:4])
    if isinstance(v, (list, dict)) and depth:
        inner = [f"{k}={shape_of(x, depth - 1)}" for k, x in sorted(v.items())] if isinstance(v, dict) else sorted({shape_of(x, depth - 1) for x in v})
        return "[" + ",".join(inner[:8]) + "]"
    return "n" if isinstance(v, (int, float)) else ""


def profiles(df: DataFrame, texts: bool = True) -> DataFrame:
    """One row per file and task with its profiled fields (columns as PROFILE);
    the values' texts are NULL where they aren't asked for.

    ``df`` has series, written_at, run_no, results. Files that aren't a JSON
    object are skipped, as are tasks that aren't one.
    """

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        for series, at, run_no, text in rows:
            try:
                doc = json.loads(text)
            except (TypeError, ValueError, RecursionError):
                continue
            for task, fields in doc.items() if isinstance(doc, dict) else ():
                if isinstance(fields, dict):
                    yield series, at, run_no, task, [
                        (f, value_type(v), number_in(v), shape_of(v), (v if v is None or isinstance(v, str) else json.dumps(v)) if texts else None)
                        for f, v in fields.items()
                    ]

    known = df.select("series", "written_at", "run_no", "results").where(
        "series IS NOT NULL AND written_at IS NOT NULL AND run_no IS NOT NULL")
    return map_partition(known, read, PROFILE)


def _name_likeness(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def _classify(gone: list[dict], come: list[dict]) -> list[tuple[str, str, str]]:
    """(kind, old, new) for the fields that went and came in one file."""
    gone = sorted(gone, key=lambda x: x["field"])
    come = sorted(come, key=lambda x: x["field"])
    weights = {}
    # what came, by type in order of its number: only numbers near enough are looked at
    by_type: dict[str, list[tuple[float, int]]] = {}
    for j, c in enumerate(come):
        if c["value_type"] is not None and c["number"] is not None:
            by_type.setdefault(c["value_type"], []).append((c["number"], j))
    for known in by_type.values():
        known.sort()
    for i, g in enumerate(gone):
        x = g["number"]
        known = by_type.get(g["value_type"], []) if x is not None else []
        reach = abs(x) * NUMBER_TOLERANCE / (1 - NUMBER_TOLERANCE) * (1 + 1e-9) if known else 0.0
        for k in range(bisect_left(known, (x - reach, -1)), len(known)) if known else ():
            y, j = known[k]
            if y > x + reach:
                break
            if same_number(x, y):
                apart = abs(x - y) / (max(abs(x), abs(y)) or 1.0)
                weights[i, j] = 0.5 * _name_likeness(g["field"], come[j]["field"]) + 0.5 * (1 - apart / NUMBER_TOLERANCE) + SHAPE * (g["shape"] == come[j]["shape"])
    pairs = best_matching(weights, len(gone), len(come))
    left, right = {i for i, _ in pairs}, {j for _, j in pairs}
    return (
        [("renamed", gone[i]["field"], come[j]["field"]) for i, j in pairs]
        + [("removed", g["field"], "") for i, g in enumerate(gone) if i not in left]
        + [("added", "", c["field"]) for j, c in enumerate(come) if j not in right]
    )


def profiled_fields(df: DataFrame, texts: bool = True) -> DataFrame:
    """One row per (series, task, file, field), and one with a NULL field for a
    file without fields, materialised, with the file's
    position among the task's files (``file_pos`` from 1), the field's position
    before and after (``prev_pos``, ``next_pos``) and ``seen_type``, the type
    last seen up to this file.

    Windows are by field, so a series with a third of all files is spread over
    its tasks and fields; file positions come from daily buckets. A field
    occurs once per file (a repeated key of a JSON object overwrites).
    """
    files = materialize(profiles(df, texts), "profiles")  # numbering reads it twice; the JSON is parsed once
    placed = running_total(
        files, ["series", "task"], F.to_date("written_at"), ["written_at", "run_no"], F.lit(1), "file_pos"
    )
    rows = placed.select("series", "task", "file_pos", "run_no", F.inline_outer("fields"))
    w = Window.partitionBy("series", "task", "field").orderBy("file_pos")
    return materialize(
        rows.withColumn("prev_pos", F.lag("file_pos").over(w))
        .withColumn("next_pos", F.lead("file_pos").over(w))
        .withColumn("prev_type", F.last("value_type", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("seen_type", F.coalesce("value_type", "prev_type")),
        "profiled",
    )


def field_changes(fields: DataFrame) -> DataFrame:
    """All changes against the preceding file (columns as CHANGES).

    ``fields`` is the result of ``profiled_fields``. The first file of a series
    has no changes; a NULL value keeps the type seen last; an empty table gives
    no row.
    """
    retyped = fields.where("value_type <> prev_type AND prev_pos = file_pos - 1").select(
        "series", "task", "file_pos", "run_no", F.lit("retyped").alias("change_kind"),
        F.col("field").alias("old_field"), F.col("field").alias("new_field"),
    )
    item = F.struct("field", F.col("seen_type").alias("value_type"), "number", "shape")
    files = fields.groupBy("series", "task", "file_pos").agg(F.first("run_no").alias("run_no"))
    moves = fields.where("field IS NOT NULL").select(
        "series", "task",
        F.inline(F.filter(F.array(
            F.when(F.coalesce(F.col("prev_pos") < F.col("file_pos") - 1, F.col("prev_pos").isNull()) & (F.col("file_pos") > 1),
                   F.struct("file_pos", F.lit(True).alias("came"), item.alias("item"))),
            F.when(F.coalesce(F.col("next_pos") > F.col("file_pos") + 1, F.col("next_pos").isNull()),
                   F.struct((F.col("file_pos") + 1).alias("file_pos"), F.lit(False).alias("came"), item.alias("item"))),
        ), lambda x: x.isNotNull())),
    )
    # at most the fields of one file come together here; a last file has no successor
    sets = (
        moves.groupBy("series", "task", "file_pos")
        .agg(F.expr("collect_list(item) FILTER (WHERE NOT came)").alias("gone"), F.expr("collect_list(item) FILTER (WHERE came)").alias("come"))
        .join(files, ["series", "task", "file_pos"])
    )

    def match(rows: Iterator[tuple]) -> Iterator[tuple]:
        for series, task, pos, run_no, gone, come in rows:
            for change in _classify(gone, come):
                yield series, task, pos, run_no, *change

    moved = map_partition(sets.select("series", "task", "file_pos", "run_no", "gone", "come"), match, CHANGES)
    return retyped.unionByName(moved)


def unified(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """(run_no, series, task, field, file_field, value_type, number, text): the same columns for
    every file, each value under the first name its field bore in the series.

    A stay of a field (its successive files) that begins with a rename is
    linked to the stay it continues; links are followed by pointer jumping, so
    a chain of k renames takes log2(k) joins.
    """
    k = ["series", "task"]
    w = Window.partitionBy(*k, "field").orderBy("file_pos")
    stays = fields.where("field IS NOT NULL").withColumn("since", F.last(F.when(F.coalesce(F.col("prev_pos") < F.col("file_pos") - 1, F.lit(True)), F.col("file_pos")), ignorenulls=True).over(w))
    stays = materialize(stays, "stays")
    ends = stays.groupBy(*k, "field", "since").agg(F.max("file_pos").alias("until"))
    renames = changes.where("change_kind = 'renamed'").select(*k, "old_field", "new_field", F.col("file_pos").alias("at"))
    e = ends.select(*k, F.col("field").alias("old_field"), F.col("since").alias("old_since"), (F.col("until") + 1).alias("at"))
    links = materialize(
        renames.join(e, [*k, "old_field", "at"]).select(
            *k, F.col("new_field").alias("name"), F.col("at").alias("since"),
            F.col("old_field").alias("root"), F.col("old_since").alias("root_since"), F.lit(False).alias("moved")),
        "links",
    )
    while True:
        up = links.select(*k, F.col("name").alias("root"), F.col("since").alias("root_since"), F.col("root").alias("up"), F.col("root_since").alias("up_since"))
        links = materialize(
            links.drop("moved").join(up, [*k, "root", "root_since"], "left").select(
                *k, "name", "since", F.coalesce("up", "root").alias("root"), F.coalesce("up_since", "root_since").alias("root_since"),
                F.col("up").isNotNull().alias("moved")),
            "links",
        )
        if links.where("moved").isEmpty():
            break
    named = links.select(*k, F.col("name").alias("field"), "since", "root")
    return stays.join(named, [*k, "field", "since"], "left").select(
        "run_no", *k, F.coalesce("root", "field").alias("field"), F.col("field").alias("file_field"), "value_type", "number", "text"
    )
