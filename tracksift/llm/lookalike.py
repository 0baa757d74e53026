"""One consistent form of texts that look alike but differ in characters.

Per text: characters without a glyph are dropped, width forms, ligatures and
blanks are folded, letters are decomposed. Per token the script sets of its
letters are intersected, where a letter that looks like letters of other
scripts belongs to all of them (the resolved script set). One script left
spells the token in it; none left means a mixed token, spelled in the script
that most of its letters allow; several left means a token that could be
written whole in any of them, spelled in the one that most tokens of the text
that allow a single script have. All of this depends only on how letters look,
so texts that look the same get the same form.

What letters look like is taken from the Unicode confusables as the ICU library
that comes with Spark holds them, read once on the driver (some 2,000 letters)
and sent along with the tasks.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition
from tracksift.session import materialize

# Letters with one glyph in several scripts, Latin letter first.
# They decide where the confusables give a script two letters for one glyph.
LOOKALIKES = {
    "CYRILLIC": "aа cс eе iі jј oо pр sѕ xх yу hһ dԁ qԛ wԝ lӏ "
                "AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ QԚ WԜ",
    "GREEK": "oο AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ jϳ",
    "ARMENIAN": "oօ hհ nո uս qզ OՕ SՏ",
}
# Scripts that are written mixed with each other; their letters are never respelled.
MIXED_WRITING = {"CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "BOPOMOFO", "IDEOGRAPHIC", "HALFWIDTH", "KANGXI"}

# characters without a glyph of their own, blanks of any width, line breaks
_INVISIBLE = re.compile(
    "[\u0000-\u0008\u000e-\u001f\u007f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e"
    "\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff]"
)
_BLANK = re.compile("[\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_LINE = re.compile("\r\n?|[\u000b\u000c\u0085\u2028\u2029]")
_HYPHEN = str.maketrans({"\u2010": "-", "\u2011": "-", "\ufe63": "-"})
_TOKEN = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
_FOLDED = {"<wide>", "<narrow>", "<noBreak>"}
#: Different texts of one form that are met with each other at once.
BLOCK = 2_000
#: Tokens whose spelling a task keeps at hand.
KEPT_TOKENS = 200_000


def _fold(ch: str) -> str:
    """The plain spelling of width forms, ligatures and letter-like signs."""
    how = unicodedata.decomposition(ch).split(" ", 1)[0]
    if how in _FOLDED or "\ufb00" <= ch <= "\ufb06" or ("\U0001d400" <= ch <= "\U0001d7ff"):
        return unicodedata.normalize("NFKC", ch)
    return ch


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        self[code] = x = _fold(chr(code))
        return x


_FOLDS = _Folds()


@lru_cache(maxsize=1)
def _foldable() -> re.Pattern:
    """Finds a character that ``_fold`` or the hyphens' table may change."""
    found = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff" and (ord(c) in _HYPHEN or _fold(c) != c)]
    return re.compile("[" + "".join(map(re.escape, found)) + "\U00010000-\U0010ffff]")


@lru_cache(maxsize=200_000)
def letter_script(ch: str) -> str:
    """The script a letter's name begins with; "" for letters common to all scripts."""
    first = unicodedata.name(ch, " ").split(" ", 1)[0]
    return "" if first in ("", "MODIFIER", "FEMININE", "MASCULINE", "DOUBLE") else first


def _glyph_case(ch: str, like: str) -> bool:
    """Whether a letter has the glyph of a capital; one without case goes by what it looks like."""
    kind = unicodedata.category(ch)
    return kind == "Lu" if kind in ("Lu", "Ll") else like.isupper()


@lru_cache(maxsize=2)
def confusables(spark: SparkSession) -> tuple[dict[str, str], frozenset[str]]:
    """(what each letter looks like, the letters in common use), from the ICU
    library of Spark's driver: two calls, whatever the number of letters."""
    icu = spark.sparkContext._jvm.com.ibm.icu.text
    letters = [c for c in map(chr, range(0x20000)) if unicodedata.category(c)[0] == "L" and letter_script(c) not in MIXED_WRITING
               and not unicodedata.decomposition(c)]
    looks = icu.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    usual = icu.UnicodeSet("[[:L:]&[:Identifier_Type=Recommended:]]")
    it = icu.UnicodeSet(usual).retain(0x0, 0x1FFFF)
    common = set()
    for i in range(it.getRangeCount()):
        common.update(map(chr, range(it.getRangeStart(i), it.getRangeEnd(i) + 1)))
    return dict(zip(letters, looks)), frozenset(c for c in letters if c in common)


class Forms:
    """Forms of texts by a table of what letters look like."""

    def __init__(self, looks: dict[str, str], usual: frozenset[str]):
        named = {pair[1]: pair[0] for pairs in LOOKALIKES.values() for pair in pairs.split()}
        modern = {letter_script(c) for c in usual}
        groups: dict[tuple[str, bool], list[str]] = {}
        for c, like in looks.items():
            like = looks.get(named[c], like) if c in named else like
            groups.setdefault((like, _glyph_case(c, like)), []).append(c)
        self.base: dict[str, str] = {}
        self.spelled: dict[str, dict[str, str]] = {}
        self.scripts: dict[str, frozenset[str]] = {}
        for (like, _), letters in groups.items():
            by_script: dict[str, list[str]] = {}
            for c in letters:
                if letter_script(c):
                    by_script.setdefault(letter_script(c), []).append(c)
            own = {script: one for script, cs in by_script.items() if (one := self._one(cs, like, named, usual, script in modern))}
            # a letter that isn't in common use is folded into the one of its script that is
            kept = [c for c in letters if own.get(letter_script(c)) == c or (letter_script(c) in own and c not in usual)]
            if len(kept) > 1:
                rep = own.get("LATIN") or min(own.values())
                for c in kept:
                    self.base[c] = rep
                for script, c in own.items():
                    self.spelled.setdefault(script, {})[rep] = c
                self.scripts[rep] = frozenset(own)
        self._start()

    def _start(self) -> None:
        self._safe = self._unsafe()
        self._tokens = lru_cache(maxsize=KEPT_TOKENS)(self._resolve)
        self._spelled = lru_cache(maxsize=KEPT_TOKENS)(self._spell)

    def __getstate__(self) -> dict:
        return {"base": self.base, "spelled": self.spelled, "scripts": self.scripts}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    @staticmethod
    def _one(letters: list[str], like: str, named: dict[str, str], usual: frozenset[str], modern: bool) -> str | None:
        """The letter of a script that has a glyph; None where two have it. In a
        script in common use only letters in common use count."""
        for some in ([c for c in letters if c in usual and c == like or c in named], [c for c in letters if c in usual]):
            if some:
                return some[0] if len(some) == 1 else None
        return None if modern or len(letters) > 1 else letters[0]

    def _unsafe(self) -> re.Pattern:
        """Finds a character that could make a text differ from its form. Texts
        without one hold only signs that stay as they are and letters that Latin
        has, so every token allows Latin and is spelled in it."""
        safe = []
        for code in range(0x2500):
            c = chr(code)
            kind = unicodedata.category(c)[0]
            stays = self._folded(c) == c and unicodedata.is_normalized("NFC", c) and kind in "LNPSZ" or c == "\n"
            parts = unicodedata.normalize("NFD", c)
            letter = kind != "L" or all(letter_script(x) == "LATIN" and self.base.get(x, x) == x for x in parts if unicodedata.category(x)[0] == "L")
            marks = all("\u0300" <= x <= "\u036f" for x in parts[1:])
            if stays and letter and marks:
                safe.append(re.escape(c))
        return re.compile("[^" + "".join(safe) + "]")

    @staticmethod
    def _folded(text: str) -> str:
        t = _INVISIBLE.sub("", text)
        if _foldable().search(t):
            t = t.translate(_FOLDS).translate(_HYPHEN)
        return _LINE.sub("\n", _BLANK.sub(" ", t))

    def _sets(self, token: str) -> Iterator[frozenset[str]]:
        for c in token:
            if not c.isalpha():
                continue
            base = self.base.get(c, c)
            own = self.scripts.get(base)
            if own is None and (script := letter_script(base)):
                own = frozenset((script,))
            if own:
                yield own

    def _resolve(self, token: str) -> tuple[str | None, str | None, frozenset[str], str]:
        """(spelling if it is settled, its script, the scripts left, kind) of a
        token; kind is ``single``, ``mixed`` or ``several``."""
        sets = list(self._sets(token))
        left = frozenset.intersection(*sets) if sets else frozenset()
        if len(left) > 1:
            return None, None, left, "several"
        if left or not sets:
            script = next(iter(left), "")
            return self._spell(token, script), script, left, "single"
        votes = Counter(s for x in sets for s in x)
        script = min(votes, key=lambda s: (-votes[s], s != "LATIN", s))
        return self._spell(token, script), script, left, "mixed"

    def _spell(self, token: str, script: str) -> str:
        """The token with every look-alike as the script has it; one that it hasn't stays as it looks."""
        own = self.spelled.get(script, {})
        return "".join(own.get(b, b) if (b := self.base.get(c)) else c for c in token)

    def long_form(self, text: str) -> tuple[str, int, int]:
        """(form, mixed tokens, tokens written whole in another script than the form has)."""
        t = unicodedata.normalize("NFD", self._folded(text))
        tokens = Counter(_TOKEN.findall(t))
        votes: Counter = Counter()
        for token, n in tokens.items():
            _, script, _, kind = self._tokens(token)
            if kind == "single":
                votes[script] += n
        top = min(votes, key=lambda s: (-votes[s], s != "LATIN", s), default="LATIN")
        mixed = whole = 0
        respelled: dict[str, str] = {}
        for token, n in tokens.items():
            new, script, left, kind = self._tokens(token)
            if kind == "several":
                script = top if top in left else min(left, key=lambda s: (-votes[s], s != "LATIN", s))
                new = self._spelled(token, script)
            if new != token:
                own = {letter_script(c) for c in token if c.isalpha()} - {""}
                mixed += n * (len(own) > 1)
                whole += n * (len(own) == 1 and script not in own)
                respelled[token] = new
            elif kind == "mixed":
                mixed += n
        if respelled:
            t = _TOKEN.sub(lambda m: respelled.get(m[0], m[0]), t)
        return unicodedata.normalize("NFC", t), mixed, whole

    def readings(self, token: str) -> tuple[str, ...]:
        """The spellings of a decomposed token in each script it could be written in, composed."""
        new, _, left, kind = self._tokens(token)
        if kind != "several":
            return (unicodedata.normalize("NFC", new),)
        return tuple(unicodedata.normalize("NFC", self._spell(token, s)) for s in sorted(left, key=lambda s: (s != "LATIN", s)))

    def letters(self, text: str) -> str:
        """The text with signs folded and letters decomposed, before tokens are looked at."""
        if self.plain(text):
            return text if text.isascii() else unicodedata.normalize("NFD", text)
        return unicodedata.normalize("NFD", self._folded(text))

    def plain(self, text: str) -> bool:
        """Whether the text is its own form without looking at its tokens."""
        return self._safe.search(text) is None

    def form(self, text: str | None) -> str | None:
        """The one form of all texts that look like ``text``; NULL for NULL, '' for ''."""
        return text if text is None or self.plain(text) else self.long_form(text)[0]


def standard_forms(spark: SparkSession) -> Forms:
    """The forms by the confusables of the session's own library."""
    return Forms(*confusables(spark))


def consistent_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, form, n_mixed, n_whole): the consistent form of every text and the
    tokens respelled in it, those of mixed scripts and those written whole in
    another script, in one narrow pass.

    NULL stays NULL and '' stays ''; a text of invisible characters becomes ''.
    Texts are taken whole; repeated rows stay repeated; other columns are left out.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("form", T.StringType()),
                           T.StructField("n_mixed", T.LongType()), T.StructField("n_whole", T.LongType())])
    forms = standard_forms(df.sparkSession)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in rows:
            yield (k, t, 0, 0) if not t or forms.plain(t) else (k, *forms.long_form(t))

    return map_partition(df.select(key, text), run, schema)


def form_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, form_hash, text_hash): 128-bit digests of form and text, for
    texts that aren't NULL or empty; the texts themselves needn't be shuffled."""
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("form_hash", T.BinaryType()), T.StructField("text_hash", T.BinaryType()),
    ])

    forms = standard_forms(df.sparkSession)

    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in rows:
            if t:
                form = forms.form(t)
                if form.strip():
                    own = digest(t)
                    yield k, own if form == t else digest(form), own

    return map_partition(df.select(key, text), run, schema)


def lookalike_pairs(df: DataFrame, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id_a, doc_id_b), smaller first: documents whose texts differ
    in characters and have the same form.

    Keys are unique integers; rows with a NULL key, or NULL, empty or invisible
    texts are left out. Forms meet as distinct texts first, where a hot group
    of plain copies is one row; a form of very many texts is cut into blocks of
    about ``block``, of which two meet in a task; only pairs of different texts are
    joined with their documents, so no pair is made that isn't in the result.
    """
    docs = materialize(form_digests(df.where(F.col(key).isNotNull()), key, text), "forms")
    texts = docs.select("form_hash", "text_hash").distinct()
    sizes = texts.groupBy("form_hash").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"), F.count("*").alias("_texts")).where("_texts > 1")
    placed = texts.join(sizes, "form_hash").select("form_hash", "text_hash", "_n", F.pmod(F.xxhash64("text_hash"), F.col("_n")).cast("int").alias("_at"))
    a = placed.select("form_hash", F.col("text_hash").alias("text_a"), F.col("_at").alias("_i"), F.explode(F.sequence(F.col("_at"), F.col("_n") - 1)).alias("_j"))
    b = placed.select("form_hash", F.col("text_hash").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("_at"))).alias("_i"), F.col("_at").alias("_j"))
    # within a block each pair is met in both orders, between two blocks in one
    meet = a.join(b, ["form_hash", "_i", "_j"]).where("_i < _j OR text_a < text_b").select("text_a", "text_b")
    left = docs.select(F.col("text_hash").alias("text_a"), F.col(key).alias("_a"))
    right = docs.select(F.col("text_hash").alias("text_b"), F.col(key).alias("_b"))
    pairs = meet.join(left, "text_a").join(right, "text_b")
    return pairs.select(F.least("_a", "_b").alias("doc_id_a"), F.greatest("_a", "_b").alias("doc_id_b"))


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, class_id, text_id, n_docs, n_texts): every document with text,
    its class of equal forms and how many documents and different texts that has.

    The class is the smallest key in it, the text likewise among plain copies.
    Counts are summed by text before they are by form, so a hot class is never
    gathered in one task.
    """
    docs = materialize(form_digests(df.where(F.col(key).isNotNull()), key, text), "forms")
    texts = docs.groupBy("form_hash", "text_hash").agg(F.min(key).alias("text_id"), F.count("*").alias("_n"))
    forms = texts.groupBy("form_hash").agg(F.min("text_id").alias("class_id"), F.sum("_n").alias("n_docs"), F.count("*").alias("n_texts"))
    named = texts.join(forms, "form_hash").select("text_hash", "text_id", "class_id", "n_docs", "n_texts")
    return docs.join(named, "text_hash").select(key, "class_id", "text_id", "n_docs", "n_texts")
