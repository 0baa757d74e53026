"""Names of models, files, sides and runs, and values written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arguments that name a model, the one that counts most first.
MODEL_ARGUMENTS = ["peft", "delta", "pretrained", "model", "path", "engine"]


def model_name(args: Column) -> Column:
    """The model's name in an argument text ``k=v,...``; '' if none names one."""
    found = [F.when(F.contains(args, F.lit(f"{k}=")), F.substring_index(F.split(args, f"{k}=", 3)[1], ",", 1)) for k in MODEL_ARGUMENTS]
    return F.coalesce(*found, F.when(args.isNotNull(), F.lit("")))


def without_none(name: Column) -> Column:
    """A metric's name without the filter ``none`` after its comma."""
    return F.regexp_replace(name, ",none$", "")


def literal(text: Column) -> Column:
    """struct<kind, number, items> of a text that is a whole number, a list or plain
    text (``int``, ``list``, ``str``); list items as texts, with quotes taken off."""
    t = F.trim(text)
    number = F.when(F.regexp_like(t, F.lit("^[0-9]+$")), t.try_cast("bigint"))
    inner = F.trim(F.regexp_extract(t, r"(?s)^\[(.*)\]$", 1))
    is_list = F.regexp_like(t, F.lit(r"(?s)^\[.*\]$"))
    parts = F.regexp_extract_all(inner, F.lit(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^,\s][^,]*)"""), F.lit(1))
    items = F.transform(parts, lambda x: F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2"))
    return F.when(text.isNotNull(), F.struct(
        F.when(number.isNotNull(), "int").when(is_list, "list").otherwise("str").alias("kind"), number.alias("number"),
        F.when(is_list, F.when(inner == "", F.array().cast("array<string>")).otherwise(items)).alias("items")))


def watched_side(video_side: Column, affected_side: Column) -> Column:
    """``A`` where the video's side (L or R) is the affected one (Left or Right), ``H``
    where it is the other; NULL for anything else."""
    known = video_side.isin("L", "R") & affected_side.isin("Left", "Right")
    return F.when(known, F.when(video_side == F.substring(affected_side, 1, 1), "A").otherwise("H"))


def video_view(view: Column) -> Column:
    """``F`` for a front view, ``S`` for either side, NULL for anything else."""
    return F.when(view == "Front", "F").when(view.isin("Left", "Right"), "S")


def local_stamp(at: Column, zone: str) -> Column:
    """``yyyyMMdd_HHmmss`` of a UTC time (without zone) in a zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), at), "yyyyMMdd_HHmmss")


def name_list(text: Column) -> Column:
    """array<struct<base, name>> of a list written in lines or groups joined by a
    slash, each a base name and its title after a tab, comma or bar (the base
    itself if there is none); of a base given twice the last title stands, at its first place."""
    groups = F.filter(F.transform(F.split(text, r"\r?\n|/"), lambda x: F.trim(x)), lambda x: x != "")

    def one(line: Column) -> Column:
        parts = F.split(line, "[\t,|]+")
        base = F.trim(F.get(parts, 0))
        title = F.trim(F.array_join(F.slice(parts, 2, 1_000_000), " "))
        return F.struct(base.alias("base"), F.when(title == "", base).otherwise(title).alias("name"))

    rows = F.filter(F.transform(groups, one), lambda r: r["base"] != "")
    bases = F.array_distinct(F.transform(rows, lambda r: r["base"]))
    return F.transform(bases, lambda b: F.element_at(F.filter(rows, lambda r: r["base"] == b), -1))
