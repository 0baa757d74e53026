"""Defects of prompt and response pairs.

An answer is read by a pushdown parser (fences, brackets, quotations, list
items and markup are pushed and popped; what is still open at the end, or an
end outside a sentence, means it was cut), compared with its prompt by greedy
string tiling, held against refusal grammars and identified by script and
character n-grams. One defect is given per pair, the first that applies of:
empty, copy, refusal, other_language, truncated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition
from tracksift.llm.languages import LanguageModel, main_script, split_words
from tracksift.llm.lookalike import Forms, standard_forms

#: Words a tile must have, and answer words outside all tiles that a copy may have.
MIN_TILE, FREE_SHARE, FREE_WORDS = 3, 0.2, 3

# What stands for no answer.
PLACEHOLDERS = {"", "na", "n a", "none", "null", "nil", "nan", "invalid", "empty", "no answer", "no response", "no reply", "tbd", "todo",
                "unknown", "undefined", "keine antwort", "keine angabe", "leer"}

# Grammars of refusals: a rule's alternatives, in which <name> stands for another rule
# and blanks for any blanks. A sentence refuses if it holds a <refusal>.
REFUSALS = {
    "refusal": ["<unable> <adverbs> <act>", "<must> <adverb>? <refuse>", "i <adverb>? <refuse> to", "(?:not|n't) be appropriate", "not appropriate for me",
                "<lie> <outside> (?:my|what i)", "something i <cannot> \\w+", "not something i (?:am|can)", "my <adverb>? <rules> <keep>", "<rules> <forbid>",
                "i(?:'d| would) rather not", "no <answer> can be given", "leave (?:this|that|the) \\w+ unanswered", "i(?:'m| am) not comfortable"],
    "unable": ["can(?:no|')t", "can not", "could not", "couldn't", "<be> not able to", "<be>? unable to", "(?:wo|will )n[o']t be able to", "not in a position to",
               "do(?:n't| not) have the ability to", "not (?:permitted|allowed) to"],
    "be": ["am", "'m", "are", "'re"],
    "act": ["help", "assist", "analy[sz]e", "answer", "respond", "reply", "comment", "judge", "provide", "offer", "give", "evaluat", "assess", "identify", "describe", "watch",
            "rate", "rating", "score", "scoring", "discuss", "share", "comply", "fulfil", "do (?:that|this|so)", "go into", "review", "make", "continue"],
    "adverbs": ["(?:\\w+ ){0,2}?"],
    "adverb": ["(?:\\w+ )"],
    "must": ["must", "have to", "need to", "will", "shall", "prefer to"],
    "refuse": ["decline", "refuse", "pass on"],
    "lie": ["fall", "falls", "go", "goes", "lie", "lies", "be", "is", "are"],
    "outside": ["outside", "outside of", "beyond"],
    "cannot": ["don't", "do not", "can't", "cannot", "won't"],
    "rules": ["guidelines", "rules", "terms", "policy", "policies", "instructions"],
    "keep": ["keep", "prevent", "forbid", "prohibit", "stop", "bar", "do not", "don't", "rule"],
    "forbid": ["rule out", "forbid", "prohibit", "prevent"],
    "answer": ["reply", "answer", "response"],
}
REFUSALS_DE = {
    "refusal": ["ablehnen", "lehne .*ab", "<modal> .*nicht .*<act>", "steht mir nicht zu", "keine <answer> .*(?:geben|möglich)"],
    "modal": ["darf", "kann", "möchte", "werde"],
    "act": ["helfen", "beurteilen", "beantworten", "bewerten", "analysieren", "kommentieren", "sagen", "geben", "machen"],
    "answer": ["auskunft", "antwort", "bewertung"],
}


def compile_grammar(rules: dict[str, list[str]], start: str = "refusal") -> re.Pattern:
    """A pattern of all sentences with a phrase of ``start``. Rules may use each
    other but not themselves; a rule followed by ``?`` may be left out with the blank after it."""

    def expand(name: str, above: tuple[str, ...]) -> str:
        if name in above:
            raise ValueError(f"rule {name} uses itself")
        return "(?:" + "|".join(part(x, (*above, name)) for x in rules[name]) + ")"

    def part(text: str, above: tuple[str, ...]) -> str:
        out = []
        for piece in re.split(r"(<\w+>\??(?: |$)?)", text):
            if m := re.fullmatch(r"<(\w+)>(\??)( ?)", piece):
                body, blank = expand(m[1], above), r"\b\s*" if m[3] else ""
                out.append(f"(?:{body}{blank})?" if m[2] else body + blank)
            else:
                out.append(piece.replace(" ", r"\s+"))
        return "".join(out)

    return re.compile(r"(?:\b|(?=n't))" + expand(start, ()), re.I | re.S)


_REFUSALS = [compile_grammar(REFUSALS), compile_grammar(REFUSALS_DE)]

_FINAL = re.compile(r"FINAL_(?:ANSWER|SCORE)\s*:[ \t]*([^\n]*?)\s*$")
_LEAD_IN = {"q", "question", "prompt", "user", "frage", "you", "ask", "asked", "input", "task"}
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<(/?)([a-z]+)>")
# Tags that need no end, and words that no list item ends with (English, German).
_NO_END = {"br", "hr", "img", "wbr", "p", "li", "dt", "dd", "tr", "td", "th"}
_DANGLING = set("a an the and or but nor because although while whose my your his her its their our of from into than "
                "der die das den dem des eine einen einem einer eines und oder aber sondern weil dass sowie von".split())
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d+[.)])[ \t]+(\S.*)")
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»"}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Pushdown:
    """What is open at the end of a text: fences, inline code, brackets,
    quotations, emphasis, tags; and its list items, if its last line is one.

    A backtick or ``**`` within a word, or ``**`` before a space, opens nothing."""

    def __init__(self, text: str):
        self.stack: list[str] = []
        i, n = 0, len(text)
        while i < n:
            c, top = text[i], self.stack[-1] if self.stack else ""
            if text.startswith("```", i):
                self.flip("```")
                i += 3
                continue
            if top in ("```", "`"):
                if c == "`" and top == "`":
                    self.stack.pop()
            elif c == "`":
                if not text[i - 1 : i].isalnum():
                    self.stack.append("`")
            elif text.startswith("**", i):
                if "**" in self.stack or not (text[i - 1 : i].isalnum() or text[i + 2 : i + 3].isspace()):
                    self.flip("**")
                i += 1
            elif c == '"':
                self.flip('"')
            elif top and _PAIRS.get(top) == c:
                self.stack.pop()
            elif c in _PAIRS:
                self.stack.append(c)
            elif c == "<" and (tag := _TAG.match(text, i)):
                if not tag[1] and tag[2] not in _NO_END:
                    self.stack.append(tag[2])
                elif tag[1] and tag[2] in self.stack:
                    self.flip(tag[2])
            i += 1
        self.items: list[str] = []
        lines = text.rstrip().split("\n")
        for x in reversed(lines if _ITEM.match(lines[-1]) else ()):
            if m := _ITEM.match(x):
                self.items.insert(0, m[1].strip())
            elif x.strip() and not x[0].isspace():
                break

    def flip(self, mark: str) -> None:
        if mark in self.stack:
            while self.stack.pop() != mark:
                pass
        else:
            self.stack.append(mark)


def _item_is_cut(items: list[str], known: set[str]) -> bool:
    """Whether the last of a list's items, which ends in no sentence's end, was cut:
    it ends in a dangling word, a joining mark or the beginning of a known word,
    or its sisters end in a mark that it lacks. An item without sisters is read
    as a sentence, which must end."""
    *sisters, last = items
    if not sisters or last[-1] in ",;:-–—/&":
        return True
    if sum(x[-1] in ".!?;,。！？" for x in sisters) * 2 > len(sisters):
        return True
    w = words(last)
    if not w or not last[-1].isalpha():
        return False
    end = w[-1]
    return end in _DANGLING or end not in known and any(x.startswith(end) for x in known)


def is_truncated(text: str, labels: frozenset[str] = frozenset(), prompt: str = "", common: frozenset[str] = frozenset()) -> bool:
    """Whether a text breaks off inside a sentence, a word, a quotation, markup, a
    list item or the closing line. Whole sentences without that line are fine, as
    are a bare label, a number or yes/no, a closed fence and a last list item
    that is like its sisters. ``prompt`` and ``common`` tell words."""
    t = text.strip()
    if m := _FINAL.search(t):
        value = m.group(1).strip()
        bare = re.sub(r"[\s\"'“”.]+", " ", value).strip().lower()
        if not bare or value.count('"') % 2:
            return True
        return bool(labels) and bare not in labels and any(x.startswith(bare) for x in labels)
    if re.search(r"FINAL_(?:ANSWER|SCORE)\s*$", t):
        return True
    state = Pushdown(t)
    if state.stack:
        return True
    if t.endswith("```"):
        return False
    end = t.rstrip("\"'”’»)]}*_` ")
    if end.endswith(("...", "…")) or re.search(r"\s\.+$", end):
        return True
    if end[-1:] in ".!?。！？":
        return False
    bare = end.lower()
    if state.items:
        item = state.items[-1].rstrip("\"'”’»)]}*_` ").lower()
        if item in labels or item in ("yes", "no", "ja", "nein") or item.isdigit():
            return False
        known = {w for x in (t[: t.rfind("\n") + 1], " ".join(words(state.items[-1])[:-1]), prompt, *labels) for w in words(x)} | common
        return _item_is_cut(state.items, known)
    return not (bare in labels or bare in ("yes", "no", "ja", "nein") or bare.isdigit())


class _Automaton:
    """Suffix automaton of a sequence; ``reach`` gives, for each place of another
    sequence, how many elements up to there stand in the first, and where there
    the first such stretch ends, in linear time. None stands nowhere."""

    def __init__(self, seq: Sequence):
        self.steps: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for i, word in enumerate(seq):
            last = 0 if word is None else self._add(last, word, i)

    def _state(self, steps: dict, link: int, length: int, first: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.steps) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of the shorter stretches that ``q`` holds when reached from ``p``."""
        copy = self._state(dict(self.steps[q]), self.link[q], self.length[p] + 1, self.first[q])
        while p >= 0 and self.steps[p].get(word) == q:
            self.steps[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _add(self, last: int, word, i: int) -> int:
        q = self.steps[last].get(word)
        if q is not None:  # the stretch has been seen before, after a break
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state({}, 0, self.length[last] + 1, i), last
        while p >= 0 and word not in self.steps[p]:
            self.steps[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.steps[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def reach(self, seq: Sequence) -> tuple[list[int], list[int]]:
        sizes, ends, state, n = [], [], 0, 0
        steps, link, length, first = self.steps, self.link, self.length, self.first
        for word in seq:
            if word is None:
                state = n = 0
            else:
                while state and word not in steps[state]:
                    state = link[state]
                    n = length[state]
                if word in steps[state]:
                    state, n = steps[state][word], n + 1
                else:
                    n = 0
            sizes.append(n)
            ends.append(first[state])
        return sizes, ends


@lru_cache(maxsize=512)
def _whole(prompt: tuple[str, ...]) -> _Automaton:
    return _Automaton(prompt)


def tiles(answer: Sequence[str], prompt: Sequence[str], min_tile: int = MIN_TILE) -> list[bool]:
    """Marks the answer's words covered by greedy string tiling.

    The longest stretches of unmarked words that stand in both texts become
    tiles, marked in both, then the next shorter, down to ``min_tile`` words. A
    round finds the stretches of one length by a suffix automaton of the prompt,
    so it is linear; the automaton is made anew from what the prompt has left
    when none of them is free there. Then the prompt is offered once more,
    whole, to what the answer has left, from its end, so an answer that says it
    several times is covered.
    """
    left, asked = list(answer), list(prompt)
    whole = now = _whole(tuple(prompt))
    while True:
        sizes, at = now.reach(left)
        size = max(sizes, default=0)
        if size < min_tile:
            break
        placed, free = False, None
        for i, n in enumerate(sizes):
            start = i + 1 - size
            if n < size or left[start] is None:
                continue
            j = at[i] + 1 - size
            if asked[j] is None or None in asked[j : j + size]:
                if free is None:  # all free stretches of that length, last one first
                    free, run = {}, 0
                    for k in range(len(asked) - 1, -1, -1):
                        run = 0 if asked[k] is None else run + 1
                        if run >= size:
                            free.setdefault(tuple(asked[k : k + size]), []).append(k)
                places = free.get(tuple(left[start : i + 1]), []) if free else []
                while places and None in asked[places[-1] : places[-1] + size]:
                    places.pop()
                if not places:
                    continue
                j = places.pop()
            left[start : i + 1] = asked[j : j + size] = [None] * size
            placed = True
        if not placed:
            now = _Automaton(asked)
    sizes, _ = whole.reach(left)
    end = len(left)
    while end:
        size = sizes[end - 1]
        if size >= min_tile:
            left[end - size : end] = [None] * size
            end -= size
        else:
            end -= 1
    return [x is None for x in left]


def is_copy(answer: str, prompt: str, covered: Sequence[bool] | None = None) -> bool:
    """Whether an answer says only what its prompt says: few of its words are
    outside the tiles, lead-ins (``Question:``) apart, and it ends in no value
    of its own."""
    a, p = words(answer), words(prompt)
    if not a or not p:
        return False
    if (m := _FINAL.search(answer.strip())) and words(m.group(1)) and " ".join(words(m.group(1))) not in " ".join(p):
        return False
    covered = tiles(a, p) if covered is None else covered
    free = sum(not c for w, c in zip(a, covered) if w not in _LEAD_IN)
    return any(covered) and free <= max(FREE_WORDS, FREE_SHARE * len(a)) and sum(covered) > free


def is_refusal(answer: str) -> bool:
    """Whether a sentence refuses and no value closes the answer."""
    t = answer.replace("’", "'")
    m = _FINAL.search(t.strip())
    return any(g.search(t) for g in _REFUSALS) and not (m and words(m.group(1)))


def in_other_language(answer: str, prompt: str, model: LanguageModel, covered: Sequence[bool] | None = None) -> bool:
    """Whether the answer's own words (the prompt's and the closing line left
    out) are clearly in another script or language than the prompt. Fewer than
    three words tell a script only, and only where it is the whole answer's. A
    prompt in a language that isn't modelled tells scripts only."""
    body = re.sub(r"FINAL_\w*\s*:?[^\n]*$", " ", answer)
    a = words(body)  # the first words of the answer
    covered = tiles(words(answer), words(prompt)) if covered is None else covered
    own = " ".join(x for x, c in zip(a, covered) if not c)
    asked_in, told_in = main_script(prompt), main_script(own)
    few = len(own.split()) < 3
    if not asked_in or not told_in or few and (told_in == "LATIN" or main_script(body) != told_in):
        return False
    if asked_in != told_in:
        return True
    return not few and model.other(split_words(prompt), split_words(own))


class Defects:
    """What defects are told by: forms of texts, languages, and labels that may end an answer."""

    def __init__(self, forms: Forms, model: LanguageModel, labels: frozenset[str] = frozenset()):
        self.forms, self.model, self.labels = forms, model, labels

    def of(self, answer: str | None, prompt: str | None) -> str | None:
        """The defect of a pair, or None. A NULL answer is empty; against a NULL or
        empty prompt neither copies nor languages are told."""
        a = self.forms.form(answer or "")
        if " ".join(words(a)) in PLACEHOLDERS:
            return "empty"
        p = self.forms.form(prompt or "")
        covered = tiles(words(a), words(p))
        if is_copy(a, p, covered):
            return "copy"
        if is_refusal(a):
            return "refusal"
        if p and in_other_language(a, p, self.model, covered):
            return "other_language"
        return "truncated" if is_truncated(a, self.labels, p, self.model.words) else None


def answer_segments(resps: Column, filtered: Column) -> Column:
    """array<string> of a sample's answer segments: those of ``resps`` in
    order over requests and repeats, else the ``<RESP>`` blocks, else one NULL."""
    flat = F.flatten(F.filter(F.flatten(F.filter(resps, lambda x: x.isNotNull())), lambda x: x.isNotNull()))
    texts = F.transform(flat, lambda s: F.try_element_at(s, F.lit(1)))
    joined = F.array_join(filtered, "\n")
    blocks = F.slice(F.split(joined, r"(?i)<\s*RESP\s*>"), 2, 2_000_000_000)
    cut = F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"(?is)<\s*TIME\s*>.*$", "")))
    none = F.array(F.lit(None).cast("string"))
    return F.when(F.size(texts) > 0, texts).when(F.size(cut) > 0, cut).otherwise(none)


def pair_defects(df: DataFrame, key: str, prompt: str, segments: Column, model: LanguageModel, labels: frozenset[str] = frozenset()) -> DataFrame:
    """Rows (key, seg_no, defect), one per defective pair, in a narrow pass.
    ``model`` is that of ``train_languages``.

    Rows delivered twice give their rows twice. Texts are read whole; an empty
    table gives no row; columns beyond those named are ignored.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("seg_no", T.LongType()), T.StructField("defect", T.StringType())])

    defects = df.sparkSession.sparkContext.broadcast(Defects(standard_forms(df.sparkSession), model, labels))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, asked, answers in rows:
            for i, answer in enumerate(answers or [None]):
                if found := defects.value.of(answer, asked):
                    yield k, i, found

    return map_partition(df.select(key, prompt, segments.alias("_segments")), run, schema)
