"""Response filters: a registry of steps on array<string>, and named pipelines.

A step maps the array of a request's responses to an array of filtered ones;
``apply_pipelines`` composes steps into one Column per pipeline, so a whole
set of pipelines is a single projection.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[Column], Column]
FILTERS: dict[str, Callable[..., Step]] = {}


def register_filter(name: str):
    def add(make: Callable[..., Step]):
        if name in FILTERS:
            raise ValueError(f"filter {name} is registered already")
        FILTERS[name] = make
        return make

    return add


@register_filter("take_first")
def take_first() -> Step:
    return lambda r: F.slice(r, 1, 1)


@register_filter("take_first_k")
def take_first_k(k: int) -> Step:
    """The first k; NULL where there are fewer."""
    return lambda r: F.when(F.size(r) >= k, F.slice(r, 1, k))


@register_filter("majority_vote")
def majority_vote() -> Step:
    """The most frequent response alone; ties go to the one seen first."""

    def step(r: Column) -> Column:
        counted = F.transform(F.array_distinct(r), lambda v: F.struct(
            F.size(F.filter(r, lambda x: x.eqNullSafe(v))).alias("n"), (-F.array_position(r, v)).alias("p"), v.alias("v")))
        return F.when(F.size(r) > 0, F.array(F.array_max(counted)["v"])).otherwise(r)

    return step


@register_filter("regex")
def regex(pattern: str, group_select: int = 0, fallback: str = "[invalid]", group: int = 1) -> Step:
    """The group_select-th match (from the end if negative), trimmed; else the fallback."""

    def step(r: Column) -> Column:
        at = group_select + 1 if group_select >= 0 else group_select
        found = lambda x: F.filter(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), lambda m: m.isNotNull())
        return F.transform(r, lambda x: F.coalesce(F.trim(F.try_element_at(found(x), F.lit(at))), F.lit(fallback)))

    return step


@register_filter("multi_choice")
def multi_choice(choices: Column, fallback: str = "[invalid]") -> Step:
    """``(A)`` by a letter in parentheses, else by the earliest choice text, else after a colon, else the fallback."""

    def one(x: Column) -> Column:
        letter = F.nullif(F.regexp_extract(x, r"\(([A-Z])\)", 1), F.lit(""))
        low = F.lower(x)
        hits = F.filter(
            F.transform(choices, lambda c, i: F.struct(F.instr(low, F.lower(c)).alias("at"), i.alias("i"))), lambda h: h["at"] > 0)
        named = F.chr(F.array_min(hits)["i"] + F.lit(ord("A")))
        colon = F.nullif(F.regexp_extract(x, r":\s*([A-Z])\b", 1), F.lit(""))
        return F.coalesce(F.concat(F.lit("("), F.coalesce(letter, named, colon), F.lit(")")), F.lit(fallback))

    return lambda r: F.transform(r, one)


@register_filter("remove_whitespace")
def remove_whitespace() -> Step:
    """One leading blank is dropped, no more."""
    return lambda r: F.transform(r, lambda x: F.regexp_replace(x, "^ ", ""))


@register_filter("lowercase")
def lowercase() -> Step:
    return lambda r: F.transform(r, F.lower)


@register_filter("uppercase")
def uppercase() -> Step:
    return lambda r: F.transform(r, F.upper)


@register_filter("map")
def mapping(table: dict[str, str], default: str | None = None) -> Step:
    keys = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return lambda r: F.transform(r, lambda x: F.coalesce(F.try_element_at(keys, x), F.lit(default).cast("string")))


@register_filter("strip_punctuation")
def strip_punctuation() -> Step:
    return lambda r: F.transform(r, lambda x: F.regexp_replace(x, r"\p{P}", ""))


@register_filter("ignore")
def ignore(case: bool = False, punctuation: bool = False, patterns: list[str] | None = None) -> Step:
    """Responses without what is to be ignored: patterns first, then case, then punctuation of any script."""
    def clean(x: Column) -> Column:
        for p in patterns or []:
            x = F.regexp_replace(x, p, "")
        x = F.lower(x) if case else x
        return F.regexp_replace(x, r"\p{P}", "") if punctuation else x

    return lambda r: F.transform(r, clean)


def simple_choice(responses: Column, question: Column) -> Column:
    """The first response as a choice's letter: the choices are the question's lines
    ``A. text``, lettered in their order; the one found earliest in the response
    without its marks counts, else that response is given. NULL without responses."""
    texts = F.transform(F.regexp_extract_all(question, F.lit(r"\b([A-Z])\.\s+([^\n]*)"), F.lit(2)), lambda x: F.trim(x))
    said = F.trim(F.regexp_replace(F.get(responses, 0), r"(?U)[^\w\s]", ""))
    hits = F.filter(F.transform(texts, lambda x, i: F.struct(F.when(x != "", F.instr(said, x)).otherwise(0).alias("at"), i.alias("i"), x.alias("x"))), lambda h: h["at"] > 0)
    first = F.array_min(hits)
    # of choices with one text the last one's letter stands
    place = F.array_max(F.transform(F.filter(hits, lambda h: h["x"] == first["x"]), lambda h: h["i"]))
    return F.when(F.size(hits) > 0, F.char(F.lit(65) + place)).otherwise(said)


def pipeline(steps: list[tuple[str, dict[str, Any]]]) -> Step:
    made = [FILTERS[name](**kwargs) for name, kwargs in steps]

    def run(r: Column) -> Column:
        for step in made:
            r = step(r)
        return r

    return run


def apply_pipelines(df: DataFrame, responses: str, pipelines: dict[str, list[tuple[str, dict[str, Any]]]]) -> DataFrame:
    """``df`` with ``filtered``: map of pipeline name -> filtered responses.

    NULL responses stay NULL per pipeline; an empty array stays empty.
    """
    cells = [x for name, steps in pipelines.items() for x in (F.lit(name), pipeline(steps)(F.col(responses)))]
    return df.withColumn("filtered", F.create_map(*cells))


def ngram_overlap(docs: DataFrame, key: str, text: str, items: DataFrame, item_text: str, n: int = 5) -> DataFrame:
    """Documents that share ``n`` successive words with an item: a semi join on n-grams.
    The items' are made unique; being few, they usually end up broadcast at run
    time, and then the documents' n-grams are never shuffled."""

    def grams(df: DataFrame, t: str, *keep: str) -> DataFrame:
        words = df.select(*keep, F.filter(F.split(F.lower(t), r"[^a-z0-9]+"), lambda w: w != "").alias("w")).where(F.size("w") >= n)
        # the generator stands between the words and their windows: a lambda over the
        # expression of the words would split the text again for each window
        at = words.select(*keep, "w", F.explode(F.sequence(F.lit(1), F.size("w") - (n - 1))).alias("i"))
        return at.select(*keep, F.concat_ws(" ", F.slice("w", F.col("i"), F.lit(n))).alias("gram"))

    return grams(docs, text, key).join(grams(items, item_text).distinct(), "gram", "left_semi").select(key).distinct()
