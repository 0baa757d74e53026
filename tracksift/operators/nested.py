"""Deeply nested records turned into linked flat tables, in one pass.

A depth-first visitor walks each JSON document once and emits rows tagged with
the table they belong to, a primary key, the parent's key and the payload. The
tagged rows are written once, partitioned by tag, and each flat table is read
from its partition with its own typed columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition
from tracksift.session import new_path

TAGGED = T.StructType([
    T.StructField("tag", T.StringType()), T.StructField("run_no", T.LongType()), T.StructField("task", T.StringType()),
    T.StructField("row_key", T.StringType()), T.StructField("parent_key", T.StringType()),
    T.StructField("parent_pos", T.LongType()), T.StructField("pos", T.LongType()),
    T.StructField("entry_name", T.StringType()), T.StructField("payload", T.StringType()),
    T.StructField("again", T.BooleanType()),
])

#: Columns each flat table gets from its payload.
PAYLOADS = {
    "score": "value string, value_type string",
    "metric": "aggregation string, higher_is_better boolean, args string",
    "filter": "n_steps bigint",
    "step": "regex_pattern string, kwargs string",
    "subtask": "test_split string, n_metrics bigint",
}


def value_type(v: Any) -> str | None:
    """number, string, list or object; NULL for null. A boolean is a number."""
    if v is None:
        return None
    if isinstance(v, (bool, int, float)):
        return "number"
    return "string" if isinstance(v, str) else "list" if isinstance(v, list) else "object"


def _loads(text: Any) -> Any:
    """Parsed JSON, or None where it isn't JSON."""
    try:
        return json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None


def _unpacked(v: Any) -> Any:
    """A list or object that was stored as a JSON string, unpacked again."""
    if isinstance(v, str) and v.lstrip()[:1] in ("[", "{"):
        inner = _loads(v)
        return v if inner is None else inner
    return v


def entries(v: Any, name_field: str) -> list[tuple[int, str | None, dict]]:
    """(pos, name, object) of a list that may come as a list, a single object,
    an object keyed by position, a bare name, or any of these as JSON text."""
    v = _unpacked(v)
    if v is None:
        return []
    if isinstance(v, dict):
        v = [v] if name_field in v or not all(k.isdigit() for k in v) else list(v.values())
    elif not isinstance(v, list):
        v = [v]
    out = []
    for pos, x in enumerate(v):
        x = _unpacked(x)
        name, body = (x.get(name_field), x) if isinstance(x, dict) else (x, {})
        if name is not None:
            out.append((pos, name if isinstance(name, str) else json.dumps(name), body))
    return out


def _text(v: Any) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


class Visitor:
    """Walks the documents of one run and gives their tagged rows one by one.

    ``again`` marks a row that says of its task what an earlier one of the run
    says too, as where two groups name the same subtask.
    """

    def __init__(self, run_no: int | None):
        self.run_no, self.n, self.said = run_no, 0, set()

    def row(self, tag: str, task: str, parent: str | None, parent_pos: int, pos: int, name: str, payload: dict) -> tuple:
        key = f"{self.run_no}.{self.n}"
        self.n += 1
        what = (tag, task, parent_pos, pos, name)
        again = what in self.said
        self.said.add(what)
        return (tag, self.run_no, task, key, parent, parent_pos, pos, name, json.dumps(payload, ensure_ascii=False), again)

    def results(self, doc: Any) -> Iterator[tuple]:
        if not isinstance(doc, dict):
            return
        for task, fields in doc.items():
            if isinstance(fields := _unpacked(fields), dict):
                for name, v in fields.items():
                    yield self.row("score", task, None, -1, -1, name, {"value": _text(v), "value_type": value_type(v)})

    def config(self, task: str, body: dict, parent: str | None) -> Iterator[tuple]:
        for pos, name, x in entries(body.get("metric_list"), "metric"):
            yield self.row("metric", task, parent, -1, pos, name, {
                "aggregation": _text(x.get("aggregation")), "higher_is_better": x.get("higher_is_better"), "args": _text(x.get("args"))})
        for pos, name, x in entries(body.get("filter_list"), "name"):
            steps = entries(x.get("filter"), "function")
            row = self.row("filter", task, parent, -1, pos, name, {"n_steps": len(steps)})
            yield row
            for i, function, step in steps:
                yield self.row("step", task, row[3], pos, i, function, {
                    "regex_pattern": _text(step.get("regex_pattern")), "kwargs": _text(step.get("kwargs"))})
        subs = _unpacked(body.get("task"))
        if isinstance(subs, (list, dict)) or ("group" in body and isinstance(subs, str)):
            for pos, name, x in entries(subs, "task"):
                inner = _unpacked(name)
                nested = isinstance(inner, (list, dict))  # a group within the group
                label = str(x.get("group", name)) if nested else name
                row = self.row("subtask", task, parent, -1, pos, label, {
                    "test_split": _text(x.get("test_split")), "n_metrics": len(entries(x.get("metric_list"), "metric"))})
                yield row
                yield from self.config(label, x if nested else {k: v for k, v in x.items() if k != "task"}, row[3])

    def configs(self, doc: Any) -> Iterator[tuple]:
        if not isinstance(doc, dict):
            return
        for task, body in doc.items():
            if isinstance(body := _unpacked(body), dict):
                yield from self.config(task, body, None)


def tagged_rows(df: DataFrame, run: str = "run_no", results: str = "results", configs: str = "configs") -> DataFrame:
    """Tagged rows of all tables (columns as TAGGED).

    NULL, empty and broken documents emit nothing; a NULL run number is
    kept; optional parts may be missing; repeated rows emit their rows again;
    other columns of ``df`` are ignored. Very deep documents that can't be
    parsed count as broken.
    """

    def visit(rows: Iterator[tuple]) -> Iterator[tuple]:
        for run_no, r, c in rows:
            v = Visitor(run_no)
            yield from v.results(_loads(r))
            yield from v.configs(_loads(c))

    return map_partition(df.select(df[run].cast("bigint"), df[results].cast("string"), df[configs].cast("string")), visit, TAGGED)


def flat_table(tagged: DataFrame, tag: str) -> DataFrame:
    """One flat table: keys, parent link, name and the payload's typed columns."""
    return (
        tagged.where(F.col("tag") == tag)
        .withColumn("_p", F.from_json("payload", PAYLOADS[tag]))
        .select("run_no", "task", "row_key", "parent_key", "parent_pos", "pos", "entry_name", "again", "_p.*")
    )


def write_tables(tagged: DataFrame, path: str) -> None:
    """All tables in one pass, partitioned by tag."""
    tagged.write.partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return flat_table(spark.read.schema(TAGGED).parquet(path), tag)


def stored_tables(tagged: DataFrame) -> dict[str, DataFrame]:
    """Each flat table by its tag, read from the tagged rows written to the shared folder."""
    path = new_path(tagged.sparkSession, "tables")
    write_tables(tagged, path)
    return {tag: read_table(tagged.sparkSession, path, tag) for tag in PAYLOADS}
