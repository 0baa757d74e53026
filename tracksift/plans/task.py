"""Evaluation tasks: from a declaration to one lazy plan.

A ``Task`` names its source, how prompts and targets come from a document, the
filter pipelines and the metrics. ``plan`` gives the requests, ``samples`` the
scored samples, ``results`` the long table of aggregates with standard errors;
each is a DataFrame built on the one before, so a whole evaluation is one plan
of Catalyst's. Names are looked up in registries, which plug-ins may fill.
"""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from fnmatch import fnmatchcase
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksift.operators.bootstrap import ROUNDS, bootstrap
from tracksift.operators.corpus_scores import COUNTS, counted_pairs, scores_of_counts
from tracksift.operators.metrics import AGGREGATIONS, STANDARD_ERRORS, anls, exact_match, sequence_hash, stderr
from tracksift.operators.responses import apply_pipelines
from tracksift.operators.scoring import DEFAULT_METRICS
from tracksift.session import materialize
from tracksift.sources.logs import template
from tracksift.sources.tables import table

#: Aggregations over (gold, pred) of all samples: of truths, and of texts.
OF_TRUTHS, OF_TEXTS = ("f1", "matthews"), ("bleu", "chrf", "ter")
#: metric name -> (filtered response, target) -> score of a sample, or a struct
#: of gold and pred where the aggregation is over pairs
METRICS: dict[str, Callable[[Column, Column], Column]] = {}
#: name -> (spark, docs) -> docs with ``resps``
RESPONSE_SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {}
TASKS: dict[str, "Task"] = {}
GROUPS: dict[str, list[str]] = {}
#: tag -> tasks that bear it
TAGS: dict[str, list[str]] = {}
#: functions that declarations may name as ``!function name``
FUNCTIONS: dict[str, Callable] = {}


def register(registry: dict, name: str):
    """Adds to a registry under a name that must be free."""

    def add(x: Any) -> Any:
        if name in registry:
            raise ValueError(f"{name} is registered already")
        registry[name] = x
        return x

    return add


@register(METRICS, "exact_match")
def _exact(pred: Column, target: Column, ignore_case: bool = False, ignore_punctuation: bool = False, regexes_to_ignore: list[str] | None = None) -> Column:
    return exact_match(pred, target, regexes_to_ignore, case=not ignore_case, punctuation=not ignore_punctuation)


@register(METRICS, "anls")
def _anls(pred: Column, target: Column, threshold: float = 0.5) -> Column:
    return anls(pred, F.array(target), threshold)


@register(METRICS, "identification")
def _identification(pred: Column, target: Column) -> Column:
    """Whether the named label is the target, both without case, blanks and punctuation."""
    plain = lambda x: F.regexp_replace(F.lower(x), r"[^a-z0-9]", "")
    return (plain(pred) == plain(target)).cast("double")


@register(METRICS, "contains")
def _contains(pred: Column, target: Column) -> Column:
    return F.contains(F.lower(pred), F.lower(target)).cast("double")


@register(METRICS, "pair")
def _pair(pred: Column, target: Column) -> Column:
    """Target and response as they are, for aggregations over pairs. As truths,
    a response that isn't one is false."""
    return F.struct(target.alias("gold"), pred.alias("pred"))


@dataclass(frozen=True)
class Task:
    """``prompt`` and ``target`` are templates, or functions of a Column expression's
    maker; ``load`` gives documents with doc_id; ``metrics`` are (metric,
    aggregation); ``args`` gives a metric keywords for its score and aggregation,
    each taking those it knows."""

    name: str
    load: Callable[[SparkSession, str], DataFrame]
    prompt: str | Callable[[], Column]
    target: str | Callable[[], Column]
    pipelines: dict[str, list[tuple[str, dict]]] = field(default_factory=lambda: {"none": [("take_first", {})]})
    metrics: tuple[tuple[str, str], ...] = (("exact_match", "mean"),)
    process: Callable[[DataFrame], DataFrame] | None = None
    repeats: int = 1
    description: str = ""
    args: dict[str, dict[str, Any]] = field(default_factory=dict)
    output_type: str = "generate_until"


def _function(x: Any) -> Any:
    """What a declaration means by a value: a registered function, or the value."""
    m = re.fullmatch(r"!function\s+([\w.]+)", x.strip()) if isinstance(x, str) else None
    if m and m[1] not in FUNCTIONS:
        raise ValueError(f"no function {m[1]} is registered")
    return FUNCTIONS[m[1]] if m else x


def _known(f: Callable, args: dict[str, Any]) -> dict[str, Any]:
    """Those keywords that a function takes."""
    names = inspect.signature(f).parameters
    return {k: v for k, v in args.items() if k in names}


def declare(config: dict[str, Any]) -> Task:
    """Registers the task of a declaration, as a dictionary or a parsed file holds it.

    ``task`` names it, ``include`` another task whose values hold where none is
    given, ``dataset`` a table's name or a function (spark, folder) -> documents,
    ``doc_to_text`` and ``doc_to_target`` templates or functions, ``process_docs``
    a function, ``tag`` one tag or several, ``metric_list`` metrics with their
    aggregation and keywords (those of ``output_type`` if there is none),
    ``filter_list`` named pipelines. ``group`` with ``task`` a list registers a
    group instead.
    """
    if "group" in config and isinstance(config.get("task"), list):
        members = [declare(x).name if isinstance(x, dict) else x for x in config["task"]]
        register(GROUPS, config["group"])(members)
        return TASKS[resolve([config["group"]])[0]]
    base = TASKS[config["include"]] if "include" in config else None
    values: dict[str, Any] = {f.name: getattr(base, f.name) for f in fields(Task)} if base else {}
    values["name"] = config["task"]
    if "dataset" in config:
        source = _function(config["dataset"])
        values["load"] = source if callable(source) else lambda spark, folder: table(spark, folder, source)
    names = {"doc_to_text": "prompt", "doc_to_target": "target", "process_docs": "process", "repeats": "repeats", "description": "description", "output_type": "output_type"}
    values |= {ours: _function(config[theirs]) for theirs, ours in names.items() if theirs in config}
    if "filter_list" in config:
        values["pipelines"] = {p["name"]: [(x["function"], {k: v for k, v in x.items() if k != "function"}) for x in p["filter"]] for p in config["filter_list"]}
    kind = values.get("output_type", "generate_until")
    if "metric_list" in config or (not base and kind in DEFAULT_METRICS):
        listed = config.get("metric_list") or [{"metric": m} for m in DEFAULT_METRICS[kind]]
        values["metrics"] = tuple((m["metric"], m.get("aggregation", "mean")) for m in listed)
        values["args"] = {m["metric"]: {k: _function(v) for k, v in m.items() if k not in ("metric", "aggregation", "higher_is_better")} for m in listed}
    task = register(TASKS, config["task"])(Task(**values))
    tags = config.get("tag", [])
    for tag in [tags] if isinstance(tags, str) else tags:
        TAGS.setdefault(tag, []).append(task.name)
    return task


def read_declarations(path: str) -> list[Task]:
    """Registers the tasks of a YAML or JSON file of one declaration or a list of them."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need a YAML reader; JSON files don't") from e

        class Loader(yaml.SafeLoader):
            """Keeps ``!function name`` as the text it is."""

        Loader.add_constructor("!function", lambda _, node: f"!function {node.value}")
        found = yaml.load(text, Loader)  # noqa: S506 (a safe loader)
    return [declare(x) for x in (found if isinstance(found, list) else [found])]


def matching(patterns: list[str], names: list[str]) -> list[str]:
    """Names that match any wildcard, sorted, each once."""
    return sorted({n for n in names for p in patterns if fnmatchcase(n, p)})


def resolve(patterns: list[str]) -> list[str]:
    """Task names of wildcards over tasks, groups and tags; groups may hold groups."""
    out: set[str] = set()
    names = lambda ps: matching(ps, [*TASKS, *GROUPS, *TAGS])
    todo = names(patterns)
    seen: set[str] = set()
    while todo:
        name = todo.pop()
        if name in seen:
            continue
        seen.add(name)
        if name in GROUPS or name in TAGS:
            todo += names(GROUPS.get(name, []) + TAGS.get(name, []))
        else:
            out.add(name)
    return sorted(out)


def requests(task: Task, spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and repeat: task, doc_id, repeat, prompt, target, hashes."""
    docs = task.load(spark, sf_dir)
    docs = task.process(docs) if task.process else docs
    text = lambda x: x() if callable(x) else template(x)
    prompt = F.concat(F.lit(task.description), text(task.prompt))
    rows = docs.select("doc_id", prompt.alias("prompt"), text(task.target).alias("target"), F.sha2(F.to_json(F.struct(*docs.columns)), 256).alias("doc_hash"))
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(task.repeats - 1)))) if task.repeats > 1 else rows.withColumn("repeat", F.lit(0))
    return rows.select(F.lit(task.name).alias("task"), "doc_id", "repeat", "prompt", "target", "doc_hash",
                       F.sha2("prompt", 256).alias("prompt_hash"), F.sha2("target", 256).alias("target_hash"))


def cached_responses(asked: DataFrame, cache: DataFrame, sampled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(requests with ``resps`` from the cache, requests still to answer).

    A response is known by its prompt's hash and the repeat it answers, where the
    cache has ``repeat``; else it answers the first only. Responses that are
    sampled (``sampled``) are never taken from the cache.
    """
    if sampled:
        return asked.withColumn("resps", F.lit(None).cast("array<string>")).where("false"), asked
    known = cache if "repeat" in cache.columns else cache.withColumn("repeat", F.lit(0))
    keys = ["prompt_hash", "repeat"]
    have = asked.join(known.select(*keys, "resps").dropDuplicates(keys), keys)
    return have, asked.join(known.select(*keys), keys, "left_anti")


def samples(task: Task, answered: DataFrame) -> DataFrame:
    """(task, doc_id, repeat, filter, metric, value, gold, pred) from requests with
    ``resps`` (array<string>); a sample has a value, or gold and pred."""
    rows = apply_pipelines(answered, "resps", task.pipelines)
    none = F.lit(None)

    def cell(p: str, m: str, a: str) -> Column:
        x = METRICS[m](F.try_element_at(F.col("filtered")[p], F.lit(1)), F.col("target"), **_known(METRICS[m], task.args.get(m, {})))
        value, gold, pred = (none, x["gold"], x["pred"]) if a in OF_TRUTHS + OF_TEXTS else (x, none, none)
        return F.struct(F.lit(p).alias("filter"), F.lit(m).alias("metric"), value.cast("double").alias("value"),
                        gold.cast("string").alias("gold"), pred.cast("string").alias("pred"))

    return rows.select("task", "doc_id", "repeat", F.inline(F.array(*[cell(p, m, a) for p in task.pipelines for m, a in task.metrics])))


def _of_texts(rows: DataFrame, score: str, keys: list[str], rounds: int) -> DataFrame:
    """(keys, value, stderr, n) of a corpus score; the pairs are counted once."""
    counted = materialize(counted_pairs(rows, keys, "pred", "gold"), "pairs")
    value = scores_of_counts(counted, keys).select(*keys, F.col(score).alias("value"), "n")
    if rounds <= 0:
        return value.select(*keys, "value", F.lit(None).cast("double").alias("stderr"), "n")
    error = bootstrap(counted, keys, [f"c{i}" for i in range(COUNTS)], score, rounds)
    return value.join(error, keys, "left").select(*keys, "value", "stderr", "n")


def results(task: Task, scored: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(task, filter, metric, value, stderr, n): one aggregate for all metrics and
    pipelines of numbers and truths, one more for each of texts. Standard errors
    without a closed form take ``rounds`` rounds of resampling (corpus scores at
    most 100), none with 0; fewer than two samples have none."""
    how, keys = dict(task.metrics), ["task", "filter", "metric"]
    gold, pred = F.col("gold").try_cast("boolean"), F.coalesce(F.col("pred").try_cast("boolean"), F.lit(False))
    scored = scored.withColumns({"_gold": gold, "_pred": F.when(gold.isNotNull(), pred)})
    value, n = F.lit(None).cast("double"), F.count("value")
    error = F.lit(None).cast("double")
    resampled, out = [], []
    for m, a in how.items():
        here = F.col("metric") == m
        rows = scored.where(here)
        if a in OF_TEXTS:
            out.append(_of_texts(rows, a, keys, rounds))
            continue
        cols = ["_gold", "_pred"] if a in OF_TRUTHS else ["value"]
        value = F.when(here, AGGREGATIONS[a](*map(F.col, cols), **_known(AGGREGATIONS[a], task.args.get(m, {})))).otherwise(value)
        if a in OF_TRUTHS:
            n = F.when(here, F.count("_gold")).otherwise(n)
        if STANDARD_ERRORS.get(a) == "closed":
            error = F.when(here, stderr(F.col("value"))).otherwise(error)
        elif STANDARD_ERRORS.get(a) == "bootstrap" and rounds > 0:
            resampled.append(bootstrap(rows, keys, cols, a, rounds))
    if len(out) < len(how):
        plain = scored.where(~F.col("metric").isin([m for m, a in how.items() if a in OF_TEXTS])) if out else scored
        table = plain.groupBy(*keys).agg(value.alias("value"), error.alias("stderr"), n.alias("n"))
        if resampled:
            errors = reduce(DataFrame.unionByName, resampled).withColumnRenamed("stderr", "_se")
            table = table.join(errors, keys, "left").select(*keys, "value", F.coalesce("stderr", "_se").alias("stderr"), "n")
        out.append(table)
    return reduce(DataFrame.unionByName, out)


def evaluate(names: list[str], spark: SparkSession, sf_dir: str, source: str, rounds: int = ROUNDS) -> DataFrame:
    """Results of all tasks that match, as one plan; ``rounds`` as in ``results``."""
    out = None
    for name in resolve(names):
        task = TASKS[name]
        answered = RESPONSE_SOURCES[source](requests(task, spark, sf_dir))
        part = results(task, samples(task, answered), rounds)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no task matches {names}")
    return out


def task_hash(asked: DataFrame) -> DataFrame:
    """(task, hash) over the samples' hashes in the order of documents and repeats."""
    hashed = asked.withColumn("_h", F.sha2(F.concat("doc_hash", "prompt_hash", "target_hash"), 256))
    return sequence_hash(hashed, ["task"], ["doc_id", "repeat"], "_h")


def hierarchy(root: str, depth: int = 0) -> list[tuple[int, str]]:
    """(depth, name) of a group's tree, members sorted, for listings."""
    out = [(depth, root)]
    for child in matching(GROUPS.get(root, []), [*TASKS, *GROUPS]):
        out += hierarchy(child, depth + 1)
    return out


def listing(spark: SparkSession, root: str | None = None) -> DataFrame:
    """(kind, name, members, shown): registered groups, tags and tasks with how many
    tasks they stand for, names indented by their depth below ``root`` if it is given."""
    if root is not None:
        rows = [("group" if n in GROUPS else "task", n, len(resolve([n])), "  " * d + n) for d, n in hierarchy(root)]
    else:
        named = [("group", GROUPS), ("tag", TAGS), ("task", TASKS)]
        rows = [(kind, n, len(resolve([n])), n) for kind, names in named for n in sorted(names)]
    return spark.createDataFrame(rows, "kind string, name string, members int, shown string")
