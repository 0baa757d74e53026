"""Text functions as Column builders; all stay inside the JVM.

NULL in gives NULL out unless a docstring says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """``text`` without white space at its ends, no-break spaces included."""
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def final_answer(text: Column, allowed: list[str] | None = None) -> Column:
    """The value after the first ``FINAL_ANSWER:``, up to a line break or ``<``,
    without one pair of quotes and trailing punctuation; '' if there is none or
    it isn't allowed. NULL counts as ''."""
    value = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?mi)FINAL_ANSWER\s*:\s*([^\n<]+)", 1))
    bare = value
    for a, b in ('""', "''", "``", "“”", "‘’"):
        wrapped = (F.length(value) >= 2) & value.startswith(a) & value.endswith(b)
        bare = F.when(wrapped, F.trim(F.substring(value, F.lit(2), F.length(value) - 2))).otherwise(bare)
    bare = F.regexp_replace(bare, "[ .;:,`'\"]+$", "")
    return F.when(bare.isin(allowed), bare).otherwise("") if allowed is not None else bare


def final_digit(text: Column) -> Column:
    """0, 1 or 2 at the very end of a FINAL_SCORE or FINAL_ANSWER line; NULL if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?i)FINAL_(?:SCORE|ANSWER)[^0-9]*([012])\s*$", 1), F.lit("")).cast("int")


def yes_no(text: Column) -> Column:
    """true if 'yes' occurs, else false if 'no' does (as a part of a word too), else NULL."""
    low = F.lower(text)
    return F.when(low.contains("yes"), True).when(low.contains("no"), False)


def lone_digit(text: Column) -> Column:
    """The first 0, 1 or 2 that stands alone."""
    return F.nullif(F.regexp_extract(text, r"\b([012])\b", 1), F.lit("")).cast("int")


def response_blocks(text: Column) -> Column:
    """array<struct<block, answer_no, answer, t0, t1>> of a ``<RESP> a <SEP> b <TIME> s-e`` text.

    Blocks without a readable time are skipped, as are empty answers.
    """
    time = r"(?i)<\s*TIME\s*>\s*([0-9.]+)\s*-\s*([0-9.]+)"
    chunks = F.filter(F.split(text, r"(?i)<\s*RESP\s*>"), lambda c: F.regexp_like(c, F.lit(time)))

    def block(c: Column, i: Column) -> Column:
        answers = F.filter(
            F.transform(F.split(F.regexp_replace(c, time, ""), r"(?i)<\s*SEP\s*>"), strip), lambda a: a != "")
        return F.transform(answers, lambda a, j: F.struct(
            i.alias("block"), j.alias("answer_no"), a.alias("answer"),
            F.regexp_extract(c, time, 1).try_cast("double").alias("t0"), F.regexp_extract(c, time, 2).try_cast("double").alias("t1")))

    return F.flatten(F.transform(chunks, block))


def response_text(segments: Column) -> Column:
    """The ``<RESP> text <TIME> a-b`` text of array<struct<text, t0, t1>>."""
    return F.array_join(F.transform(segments, lambda s: F.format_string("<RESP> %s <TIME> %.3f-%.3f ", s["text"], s["t0"], s["t1"])), "")


def typed_args(text: Column) -> Column:
    """map<string,struct<kind,value>> of ``k=v,k2=v2``; kinds bool, int, float, str are tried in this order."""
    pairs = F.filter(F.split(text, r"(?<!\\),"), lambda p: F.contains(p, F.lit("=")))

    def entry(p: Column) -> Column:
        v = F.trim(F.substring(p, F.instr(p, "=") + F.lit(1), F.length(p)))
        low = F.lower(v)
        kind = (F.when(low.isin("true", "false"), "bool").when(v.try_cast("bigint").isNotNull() & ~F.contains(v, F.lit(".")), "int")
                .when(v.try_cast("double").isNotNull(), "float").otherwise("str"))
        return F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.struct(kind.alias("kind"), v.alias("value")).alias("value"))

    return F.map_from_entries(F.transform(pairs, entry))


def sanitized_name(text: Column) -> Column:
    """A name that can be a file's: anything but letters, digits and ``-_.`` becomes ``_``."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.\-]", "_")


def elided(text: Column, width: int) -> Column:
    """``text`` cut in its middle to about ``width`` characters."""
    half = max(1, (width - 5) // 2)
    return F.when(F.length(text) <= width, text).otherwise(
        F.concat(F.substring(text, 1, half), F.lit(" ... "), F.substring(text, -half, half)))


def clock(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``."""
    ms = F.floor(seconds * 1000.0 + 0.5)
    return F.format_string("%02d:%02d:%02d.%03d", F.expr("1L") * F.floor(ms / 3600000), F.pmod(F.floor(ms / 60000), F.lit(60)),
                           F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def capitals(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Z]", "")


def detokenized(text: Column) -> Column:
    """Text with the blanks of a tokenizer taken back before punctuation and inside contractions."""
    for pattern, to in ((" 's\\b", "'s"), (" n't\\b", "n't"), (r" ([.,;:!?)])", "$1"), (r"([(]) ", "$1"), (" +", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def common_prefix_length(a: Column, b: Column) -> Column:
    """How many elements two arrays share from their start."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i <= n, F.element_at(a, i) != F.element_at(b, i)).otherwise(False))
    return F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n)


def glob_like(pattern: str) -> str:
    """A regular expression for a shell wildcard."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


# Punctuation taken out of answers, number words, articles.
ANSWER_PUNCTUATION = ";/[]\"{}()=+\\_-><@`,?!"
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]
# Contractions as they are written in full; each is also found with apostrophes left out.
CONTRACTIONS = (
    "ain't aren't can't could've couldn't couldn't've didn't doesn't don't hadn't hadn't've hasn't haven't he'd he'd've he's how'd how'll how's "
    "I'd've I'm I've isn't it'd it'd've it'll let's ma'am mightn't mightn't've might've mustn't must've needn't not've o'clock oughtn't shan't "
    "she'd've she's should've shouldn't shouldn't've somebody'd've somebody'll somebody's someone'd someone'd've someone'll someone's something'd "
    "something'd've something'll 'ow's'at that's there'd there'd've there're there's they'd they'd've they'll they're they've 'twas wasn't we'd've we've "
    "weren't what'll what're what's what've when's where'd where's where've who'd who'd've who'll who's who've why'll why're why's won't would've "
    "wouldn't wouldn't've y'all y'all'll y'all'd've you'd you'd've you'll you're you've"
).split()
# Words that are contractions only as they stand, which is how they are meant.
NOT_CONTRACTIONS = {"lets", "shes"}


def contraction_table() -> dict[str, str]:
    """Spelling with one apostrophe left out -> contraction."""
    left_out = {full[:i] + full[i + 1 :]: full for full in CONTRACTIONS for i, c in enumerate(full) if c == "'"}
    return {k: v for k, v in left_out.items() if k not in NOT_CONTRACTIONS}


def answer_tokens(text: Column) -> Column:
    """A short answer made comparable: lower case, no ',', '?' or articles,
    punctuation dropped where it stands beside a blank (or between digits) and
    turned into a blank elsewhere, periods kept only inside numbers, number
    words as digits, contractions with their apostrophes."""
    t = F.trim(F.regexp_replace(F.replace(F.translate(F.lower(text), ",?", ""), F.lit("'s"), F.lit(" 's")), "[\n\t]", " "))
    # a fold over the marks whose state carries the text, so that it is made once
    # and not again for each mark (as a lambda over its expression would)
    start = F.struct(t.alias("out"), t.alias("t"), F.regexp_like(t, F.lit(r"[0-9](,)[0-9]")).alias("commas"))

    def drop(s: Column, p: Column) -> Column:
        beside = F.contains(s["t"], F.concat(p, F.lit(" "))) | F.contains(s["t"], F.concat(F.lit(" "), p)) | s["commas"]
        out = F.when(beside, F.replace(s["out"], p, F.lit(""))).otherwise(F.replace(s["out"], p, F.lit(" ")))
        return F.struct(out.alias("out"), s["t"].alias("t"), s["commas"].alias("commas"))

    out = F.aggregate(F.array(*[F.lit(p) for p in ANSWER_PUNCTUATION]), start, drop, lambda s: s["out"])
    out = F.regexp_replace(out, r"(?<![0-9])\.|\.(?![0-9])", "")
    words = F.filter(F.split(F.trim(out), " +"), lambda w: ~w.isin(ARTICLES) & (w != ""))
    numbers = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    whole = F.create_map(*[F.lit(x) for kv in contraction_table().items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(numbers, w), F.try_element_at(whole, w), w)), " ")
