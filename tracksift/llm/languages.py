"""Telling languages by character n-grams, trained on labelled texts.

A model holds, per language, the counts of a bounded sample's n-grams of up to
five characters inside words. A character's chance given the ones before it is
blended from all orders (Witten-Bell). Words are scored one by one and the mean
is taken over characters, so what is compared is nats per character.

Languages that were never trained are told as well: besides the languages there
is a background for each script, the pooled pairs of characters of all its
languages. A language's own text costs little more in its model than in the
background, whatever it is about; other languages cost much more.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition

#: Labelled texts used per language; characters of an n-gram; n-grams kept per
#: language at least this often; words kept per language.
SAMPLE_ROWS, ORDER, LEAST, TOP_WORDS = 1_000, 5, 2, 2_000
#: Languages with fewer labelled texts aren't modelled.
LEAST_ROWS = 5
#: Nats per character, and in all, by which another modelled language must be
#: better; and by which the background must be, with what is added for short texts.
BETTER, BETTER_IN_ALL, BACKGROUND, SHORT = 0.3, 6.0, 1.0, 3.4

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def language_name(lang: Column) -> Column:
    """``en`` of ``en``, ``EN`` or ``en-US``; NULL if there is none."""
    name = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))
    return F.when(name != "", name)


def _grams(word: str) -> Iterator[str]:
    w = f"\n{word}\n"
    for i in range(1, len(w)):
        for n in range(min(ORDER, i + 1)):
            yield w[i - n : i + 1]


class LanguageModel:
    """``counts`` per language: n-gram -> times seen; ``words``: frequent words."""

    def __init__(self, counts: dict[str, dict[str, int]], words: frozenset[str] = frozenset()):
        self.counts, self.words = counts, words
        self._start()

    def _start(self) -> None:
        self.script = {k: main_script("".join(g * min(n, 1000) for g, n in c.items() if len(g) == 1)) for k, c in self.counts.items()}
        self.tables = dict(self.counts)
        for script in set(self.script.values()):
            pooled: Counter = Counter()
            for k, c in self.counts.items():
                if self.script[k] == script:
                    whole = sum(n for g, n in c.items() if len(g) == 1)
                    pooled.update({g: n / whole for g, n in c.items() if len(g) <= 2})
            self.tables["", script] = {g: max(1, int(n * 20_000)) for g, n in pooled.items()}
        self.after: dict = {}
        for name, grams in self.tables.items():
            after: dict[str, tuple[int, int]] = {}
            for g, n in grams.items():
                total, kinds = after.get(g[:-1], (0, 0))
                after[g[:-1]] = (total + n, kinds + 1)
            self.after[name] = after
        self.cost = lru_cache(maxsize=200_000)(self._cost)

    def __getstate__(self) -> dict:
        return {"words": self.words, "counts": self.counts}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _cost(self, name: str | tuple[str, str], word: str) -> float:
        """Nats of a word in a language, or in a script's background."""
        counts, after, w, nats = self.tables[name], self.after[name], f"\n{word}\n", 0.0
        for i in range(1, len(w)):
            p = 1e-4
            for n in range(min(ORDER, i + 1)):
                total, kinds = after.get(w[i - n : i], (0, 0))
                if not total:
                    break
                p = (counts.get(w[i - n : i + 1], 0) + kinds * p) / (total + kinds)
            nats -= math.log(p)
        return nats

    def nats(self, lang: str | tuple[str, str], words: list[str]) -> float:
        """Nats per character of some words (each with its end), lower-cased."""
        return sum(self.cost(lang, w) for w in words) / max(1, sum(len(w) + 1 for w in words))

    def best(self, words: list[str]) -> str | None:
        """The modelled language of the words' script that suits them best; None if there is none."""
        script = main_script("".join(words))
        able = [k for k, x in self.script.items() if x == script]
        return min(able, key=lambda k: (self.nats(k, words), k)) if words and able else None

    def unlike(self, lang: str, words: list[str]) -> bool:
        """Whether words cost more in a language than text of that language would."""
        over = self.nats(lang, words) - self.nats(("", self.script[lang]), words)
        return over > BACKGROUND + SHORT / math.sqrt(len(words))

    def better(self, lang: str, words: list[str]) -> bool:
        """Whether another modelled language of that script clearly suits the words better."""
        best = self.best(words)
        gain = self.nats(lang, words) - self.nats(best, words) if best else 0.0
        return gain > BETTER and gain * sum(len(w) + 1 for w in words) > BETTER_IN_ALL

    def other(self, asked: list[str], told: list[str]) -> bool:
        """Whether words are of another language than those asked in, of the same
        script: one that is modelled, or, where the language asked in is, any."""
        lang = self.best(asked)
        if not lang or not told:
            return False
        return self.better(lang, told) or self.unlike(lang, told) and not self.unlike(lang, asked)


def letter_script(c: str) -> str:
    """A letter's script by its Unicode name, "" if it is of none (signs, styled letters)."""
    first = re.split(r"[ -]", unicodedata.name(unicodedata.normalize("NFKC", c)[0], ""), maxsplit=1)[0]
    return "" if first in ("", "MODIFIER", "FEMININE", "MASCULINE", "DOUBLE", "TURNED", "ALEF", "KANGXI") else first


_script_of = lru_cache(maxsize=65536)(letter_script)


def main_script(text: str) -> str | None:
    """The script of most letters, None without letters. Kana makes Chinese
    characters Japanese, and fewer of them than Hangul are Korean."""
    n = Counter(map(_script_of, filter(str.isalpha, text)))
    del n[""]
    kana, han = n.pop("HIRAGANA", 0) + n.pop("KATAKANA", 0), n.pop("CJK", 0)
    for name, part in (("JAPANESE", kana * 20 >= kana + han and kana), ("HANGUL", n["HANGUL"] > han)):
        if part:
            n[name] += kana + han
            break
    else:
        n["CJK"] = han + kana
    top = max(n, key=lambda x: (n[x], x == "LATIN"))
    return top if n[top] else None


def split_words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def train_languages(df: DataFrame, text: str, lang: Column, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model of every language with LEAST_ROWS labelled texts or more.

    Per language the ``sample_rows`` texts whose hash is lowest are taken, whole;
    their n-grams are counted where they lie and only counts reach the driver.
    NULL or empty texts and rows without a language aren't used; an empty table
    gives a model without languages, which tells none.
    """
    rows = df.select(lang.alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).where("lang IS NOT NULL AND text <> ''")
    # the sample is found by hashes alone, so texts aren't shuffled; copies of a text count once
    w = Window.partitionBy("lang").orderBy("h")
    taken = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample_rows).select("lang", "h")
    # at most sample_rows for each name of two or three letters
    sample = rows.join(F.broadcast(taken), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("part", T.StringType()), T.StructField("item", T.StringType()), T.StructField("n", T.LongType())])

    def count(batch: Iterator[tuple]) -> Iterator[tuple]:
        held: Counter = Counter()
        for language, t in batch:
            for word, times in Counter(split_words(t)).items():
                held[language, "word", word] += times
            held[language, "rows", ""] += 1
        grams: Counter = Counter()
        for (language, part, word), times in held.items():
            if part == "word":
                for g in _grams(word):
                    grams[language, "gram", g] += times
        for key, times in (held + grams).items():
            yield *key, times

    found = map_partition(sample.select("lang", "text"), count, schema).groupBy("lang", "part", "item").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "item")
    kept = found.withColumn("place", F.row_number().over(top)).where(
        (F.col("part") != "word") & ((F.col("part") != "gram") | (F.col("n") >= LEAST)) | (F.col("part") == "word") & (F.col("place") <= TOP_WORDS))
    counts: dict[str, dict[str, int]] = {}
    words, n_rows = set(), Counter()
    for r in kept.collect():
        if r["part"] == "gram":
            counts.setdefault(r["lang"], {})[r["item"]] = r["n"]
        elif r["part"] == "word":
            words.add(r["item"])
        else:
            n_rows[r["lang"]] = r["n"]
    return LanguageModel({k: c for k, c in counts.items() if n_rows[k] >= LEAST_ROWS}, frozenset(words))
