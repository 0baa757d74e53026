"""Readers and writers of logs and tables kept as files."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition

#: A logged sample, one JSON line each; open parts stay JSON text.
SAMPLE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("target", T.StringType()), T.StructField("arguments", T.MapType(T.StringType(), T.StringType())),
    T.StructField("resps", T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))), T.StructField("filtered_resps", T.ArrayType(T.StringType())),
    T.StructField("qids", T.StringType()), T.StructField("doc_hash", T.StringType()), T.StructField("prompt_hash", T.StringType()),
    T.StructField("target_hash", T.StringType()), T.StructField("input", T.StringType()), T.StructField("doc", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """A table of declared schema; a row that doesn't fit it fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, sep=sep, header=header)


def read_ids(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """One id per line, blank lines and a header left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    return lines.where(F.col("id") != header) if header else lines


def read_samples(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """Sample logs (JSON lines, gz too) with their file; broken lines are kept in
    ``_corrupt_record`` if ``tolerant``, else they fail the read."""
    rows = spark.read.schema(SAMPLE).option("mode", "PERMISSIVE" if tolerant else "FAILFAST").option("recursiveFileLookup", True).json(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, lines from 1 in each file.

    Lines are numbered within the splits that a file is read in; how many lines the
    splits before it have is summed from one row per split, so no file has to be
    read by one task (compressed ones are one split anyway).
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("at", T.LongType()), T.StructField("value", T.StringType())])

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        split, n = None, 0
        for file, start, value in rows:
            split, n = ((file, start), 1) if (file, start) != split else (split, n + 1)
            yield file, start, n, value

    placed = map_partition(lines, count, schema)
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("file", "start").agg(F.max("at").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return placed.join(sizes.select("file", "start", "before"), ["file", "start"]).select("file", (F.col("at") + F.col("before")).alias("line_no"), "value")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_no, fields): JSON lines, blank ones skipped; a broken one fails the
    read and is named by its file and line."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    broken = F.concat(F.lit("no JSON object in "), "file", F.lit(", line "), F.col("line_no").cast("string"))
    object_ = F.when(F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")), F.col("value")).otherwise(F.raise_error(broken))
    return rows.select("file", "line_no", F.from_json(object_, schema).alias("r")).select("file", "line_no", "r.*")


def scan_results(spark: SparkSession, path: str, glob: str = "*_results.json") -> DataFrame:
    """(path, folder, stamp, results, configs): one row per result file below ``path``,
    whatever folder it lies in; files that aren't a JSON object are skipped."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "results string, configs string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    kept = rows.where("d IS NOT NULL AND d._corrupt IS NULL")
    folder = F.element_at(F.split(F.regexp_replace("path", "/[^/]*$", ""), "/"), -1)
    return kept.select("path", folder.alias("folder"), stamp_in(F.col("path")).alias("stamp"), "d.results", "d.configs")


def models_with_logs(files: DataFrame, path: str = "path") -> DataFrame:
    """(model, n_logs): folders that hold a log, by the folder's name."""
    folder = F.element_at(F.split(F.regexp_replace(path, "/[^/]*$", ""), "/"), -1)
    return files.groupBy(folder.alias("model")).agg(F.count("*").alias("n_logs"))


def json_records(text: str) -> Iterator[str]:
    """The JSON objects of a text, whatever stands between them: lines, one array,
    or objects over several lines. Broken ones are skipped."""
    decoder, i = json.JSONDecoder(), 0
    while (i := text.find("{", i)) >= 0:
        try:
            _, end = decoder.raw_decode(text, i)
        except ValueError:
            i += 1
            continue
        yield text[i:end]
        i = end


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that may be JSON lines, arrays or concatenated objects, parsed
    to ``schema``; one file is read by one task."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    out = T.StructType([T.StructField("file", T.StringType()), T.StructField("record", T.StringType())])

    def split(rows: Iterator[tuple]) -> Iterator[tuple]:
        for file, text in rows:
            for record in json_records(text):
                yield file, record

    return map_partition(files, split, out).select("file", F.from_json("record", schema).alias("r")).select("file", "r.*")


def stamp_in(path: Column) -> Column:
    """The ``yyyyMMdd_HHmmss`` in a file's name as a sortable text; NULL if there is none."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), "([0-9]{8}_[0-9]{6})", 1), F.lit(""))


def newest_per_folder(files: DataFrame, path: str = "path", modified: str | None = None) -> DataFrame:
    """(folder, path): of each folder the file with the latest stamp in its name, then the latest modified."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    key = F.struct(F.coalesce(stamp_in(F.col(path)), F.lit("")).alias("s"), (F.col(modified) if modified else F.lit(0)).alias("m"), F.col(path).alias("p"))
    return files.groupBy(folder.alias("folder")).agg(F.max(key).alias("k")).select("folder", F.col("k.p").alias("path"))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, length) of all files below ``path``, without reading them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.col("modificationTime").alias("modified"), "length")


def replayed(docs: DataFrame, logged: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """``docs`` with the logged responses of the newest run: a join on ``keys``
    after keeping the latest row per key by an aggregate."""
    latest = logged.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")
    return docs.join(latest, keys, "left")


def constant_source(docs: DataFrame, answer: str, out: str = "resps") -> DataFrame:
    return docs.withColumn(out, F.array(F.lit(answer)))


def modal_depth(files: DataFrame, path: str) -> DataFrame:
    """Files whose path has the most frequent depth; ties go to the smaller."""
    depth = F.size(F.split(path, "/"))
    top = files.groupBy(depth.alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d"))
    return files.join(top, depth == F.col("d"), "left_semi")


# --- sinks -----------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def concat_jsonl(spark: SparkSession, paths: list[str], out: str) -> None:
    """The non-blank lines of several logs as one log of as many parts as they had."""
    spark.read.text(paths).where(F.trim("value") != "").write.text(out)


def markdown_table(df: DataFrame, max_rows: int = 1000) -> str:
    """A report table; refuses more than ``max_rows`` rows, as it is made on the driver."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a report has at most {max_rows} rows")
    head = "|" + "|".join(df.columns) + "|\n|" + "|".join("---" for _ in df.columns) + "|\n"
    return head + "".join("|" + "|".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|") for v in r) + "|\n" for r in rows)


def results_document(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): the results of a run as one JSON text, task -> ``metric,filter``
    -> value, its error beside it as ``metric_stderr,filter`` (null if it has none), and
    the number of samples per task. ``results`` has task, filter, metric, value, stderr,
    n; what one run holds is as small as its tasks' metrics."""
    key = lambda m: F.concat(m, F.lit(","), "filter")
    entries = F.flatten(F.collect_list(F.array(F.struct(key(F.col("metric")).alias("k"), F.col("value").alias("v")), F.struct(key(F.concat("metric", F.lit("_stderr"))).alias("k"), F.col("stderr").alias("v")))))
    tasks = results.groupBy(*keys, "task").agg(F.map_from_entries(F.array_sort(entries)).alias("v"), F.max("n").alias("n"))
    by_task = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", c))))
    # maps as values can't be sorted by, so tasks are ordered by name first
    named = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("task", F.to_json("v", {"ignoreNullFields": "false"}).alias("j")))), lambda x: F.struct(x["task"], x["j"])))
    texts = tasks.groupBy(*keys).agg(named.alias("r"), by_task("n").alias("n"))
    body = F.array_join(F.transform(F.map_entries("r"), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), e["value"])), ",")
    body = F.regexp_replace(body, r'\["((?:[^"\\]|\\.)*)"\]:\{', r'"$1":{')
    return texts.select(*keys, F.concat(F.lit('{"results":{'), body, F.lit('},"n-samples":'), F.to_json("n"), F.lit("}")).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One text file line per document."""
    documents.select(F.col("document").alias("value")).write.text(path)


def stringified(df: DataFrame, column: str) -> Column:
    """A nested column with every number and truth in it as text, lists and fields kept."""
    def as_text(t: T.DataType) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(as_text(t.elementType))
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, as_text(f.dataType)) for f in t.fields])
        if isinstance(t, T.MapType):
            return T.MapType(T.StringType(), as_text(t.valueType))
        return T.StringType()

    return F.col(column).cast(as_text(df.schema[column].dataType))


def sample_table(samples: DataFrame, output_type: str) -> DataFrame:
    """Logged samples as a flat table: id, data, input_len, labels, output_type and
    the raw and filtered prediction, by the kind of request.

    ``samples`` has doc_id, target, arguments (array of [prompt, continuation]),
    resps and filtered_resps: for ``generate_until`` and ``loglikelihood_rolling``
    arrays of answers, for ``loglikelihood`` arrays of struct<ll, greedy>, for
    ``multiple_choice`` arrays of log likelihoods, one per choice (and a column
    ``choices``). Missing parts are NULL.
    """
    first = F.get(F.col("arguments"), 0)
    said, kept = F.get("resps", 0), F.get("filtered_resps", 0)
    data, label, extra = F.get(first, 0), F.col("target"), []
    if output_type == "loglikelihood":
        tell = lambda x: F.concat(F.lit("log probability of continuation is "), x["ll"].cast("string"), F.lit("\n\ncontinuation will "), F.when(x["greedy"], "").otherwise("not "), F.lit("be generated with greedy sampling"))
        label, raw, filtered = F.get(first, 1), tell(said), tell(kept)
    elif output_type == "multiple_choice":
        best = lambda c: (F.array_position(c, F.array_max(c)) - 1).cast("string")
        raw, filtered = best(F.col("resps")), best(F.col("filtered_resps"))
        lines = F.transform(F.col("arguments"), lambda a, i: F.concat(i.cast("string"), F.lit(". "), F.get(a, 1)))
        extra = [F.array_join(lines, "\n").alias("choices")]
    elif output_type in ("generate_until", "loglikelihood_rolling"):
        raw, filtered = said.cast("string"), kept.cast("string")
    else:
        raise ValueError(f"no table for {output_type}")
    return samples.select(F.col("doc_id").alias("id"), data.alias("data"), *extra, F.length(data).alias("input_len"), label.alias("labels"),
                          F.lit(output_type).alias("output_type"), raw.alias("raw_predictions"), filtered.alias("filtered_predictions"))


def frame_key(shape: Column, kind: Column, data: Column, confidence: Column) -> Column:
    """What a detection on a frame is kept under: a hash of its shape, type, bytes and threshold."""
    head = F.concat_ws("|", shape.cast("string"), kind, confidence.cast("string"))
    return F.sha2(F.concat(F.encode(head, "UTF-8"), F.lit(bytearray(b"|")), data), 256)


def with_cached(df: DataFrame, key: str, cache: DataFrame, values: list[str]) -> DataFrame:
    """``df`` with the cache's values and ``cached``; the cache has one row per key."""
    known = cache.select(F.col(key).alias("_ck"), *values).dropDuplicates(["_ck"])
    return df.join(known, F.col(key) == F.col("_ck"), "left").withColumn("cached", F.col("_ck").isNotNull()).drop("_ck")


def latex_cells(df: DataFrame, group: list[str], value: str, error: str, higher_is_better: bool = True) -> DataFrame:
    """``df`` with ``cell``: value and error as text, the best of its group bold, the second underlined."""
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last(value) if higher_is_better else F.asc_nulls_last(value))
    text = F.format_string("%.2f $\\pm$ %.2f", F.col(value), F.coalesce(F.col(error), F.lit(0.0)))
    rank = F.rank().over(w)
    return df.withColumn("cell", F.when(rank == 1, F.concat(F.lit("\\textbf{"), text, F.lit("}"))).when(rank == 2, F.concat(F.lit("\\underline{"), text, F.lit("}"))).otherwise(text))


def annotation_rows(marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, times): an item's start and end marks as ``s:1.000,e:2.000`` in time order;
    ``marks`` has kind (s, e or other, left out) and at."""
    token = F.concat("kind", F.lit(":"), F.format_string("%.3f", F.col("at")))
    items = F.array_sort(F.collect_list(F.struct("at", F.when(F.col("kind") == "s", 1).otherwise(0).alias("o"), token.alias("x"))))
    return marks.where("kind IN ('s', 'e')").groupBy(*keys).agg(F.array_join(F.transform(items, lambda i: i["x"]), ",").alias("times"))


def clip_times(text: Column, margin: float = 0.1) -> Column:
    """struct<t0, t1> of a ``s:1.2,e:3.4,...`` text: the second clip if there are
    several, else the first, widened by ``margin``; NULL for an odd number of marks."""
    marks = F.filter(F.split(text, ","), lambda m: F.regexp_like(F.trim(m), F.lit("^[se]:[0-9.]+$")))
    at = lambda i: F.substring_index(F.try_element_at(marks, i), ":", -1).try_cast("double")
    pick = F.when(F.size(marks) >= 4, F.struct((at(F.lit(3)) - margin).alias("t0"), (at(F.lit(4)) + margin).alias("t1"))).otherwise(
        F.struct((at(F.lit(1)) - margin).alias("t0"), (at(F.lit(2)) + margin).alias("t1")))
    return F.when((F.size(marks) % 2 == 0) & (F.size(marks) > 0), pick)


def normalized_path(path: Column) -> Column:
    return F.lower(F.replace(F.replace(path, F.lit(" "), F.lit("_")), F.lit("__"), F.lit("_")))


def chat_messages(system: Column | None, shots: Column, question: Column, multi_turn: bool) -> Column:
    """array<struct<role, content>> of a few-shot prompt: a system message if there is
    one, then the examples (array<struct<question, answer>>) as turns, or all in the
    user's one message."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    head = F.array(say("system", system)) if system is not None else F.array().cast("array<struct<role:string,content:string>>")
    if multi_turn:
        turns = F.flatten(F.transform(shots, lambda s: F.array(say("user", s["question"]), say("assistant", s["answer"]))))
        return F.concat(head, turns, F.array(say("user", question)))
    text = F.array_join(F.concat(F.transform(shots, lambda s: F.concat(s["question"], F.lit(" "), s["answer"])), F.array(question)), "\n\n")
    return F.concat(head, F.array(say("user", text)))


_FIELD = re.compile(r"\{\{\s*(\w+)((?:\s*\|\s*\w+(?:\(\s*(?:'[^']*'\s*,?\s*)*\))?)*)\s*\}\}")
_PIPE = re.compile(r"\|\s*(\w+)(?:\(((?:\s*'[^']*'\s*,?)*)\s*\))?")
#: What a template's field may be piped through; each takes the value and texts.
TEMPLATE_FILTERS: dict[str, Callable[..., Column]] = {
    "regex_replace": lambda x, a, b="": F.regexp_replace(x, a, b), "replace": lambda x, a, b: F.replace(x, F.lit(a), F.lit(b)),
    "lower": F.lower, "upper": F.upper, "trim": F.trim, "capitalize": lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000_000))),
    "title": F.initcap, "default": lambda x, a: F.when(x == "", a).otherwise(x), "length": lambda x: F.length(x).cast("string"),
}


def template(text: str) -> Column:
    """A ``{{ field }}`` template as one concatenation; a field may be piped through any
    of TEMPLATE_FILTERS, one after the other (``{{ f | trim | replace('a', 'b') }}``). A
    NULL field is empty; an unknown one fails when the plan is analysed, an unknown filter at once."""
    parts, at = [], 0
    for m in _FIELD.finditer(text):
        if m.start() > at:
            parts.append(F.lit(text[at : m.start()]))
        value = F.coalesce(F.col(m[1]).cast("string"), F.lit(""))
        for name, args in _PIPE.findall(m[2]):
            if name not in TEMPLATE_FILTERS:
                raise ValueError(f"no template filter {name}")
            value = TEMPLATE_FILTERS[name](value, *re.findall(r"'([^']*)'", args))
        parts.append(value)
        at = m.end()
    parts.append(F.lit(text[at:]))
    return F.concat(*parts)
