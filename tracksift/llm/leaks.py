"""Test passages that stand in a training corpus, by an FM-index per shard.

Documents are read in shards of bounded size. Of each shard's words a suffix
array, its Burrows-Wheeler transform and a wavelet matrix are built, once,
whatever is searched; all passages of the test items are searched backwards at
once through wavelet ranks, occurrences are located by walking to sampled
suffix positions, compared word by word and merged into spans. Every document
is indexed; nothing is shuffled but the few spans found.

Words are indexed under a coarse key that is the same for all spellings that
look alike or differ in case, whatever the text around them; the comparison
that follows asks whether two words have a reading in common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition
from tracksift.llm.lookalike import Forms, standard_forms
from tracksift.session import discard, materialize

#: Successive words that make a leak; words in a shard; words of items searched in one pass.
LEAK_WORDS, SHARD_WORDS, ITEM_WORDS = 12, 400_000, 400_000
#: Every so many text positions the suffix array is kept.
SAMPLE = 32

_WORD = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f])*")


class Words:
    """Words as compared: without case, punctuation and what can't be seen."""

    def __init__(self, forms: Forms):
        self.forms = forms
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.get(c, c) != c:
                c = root[c]
            return c

        for letter, rep in forms.base.items():
            a, b = letter.casefold(), rep.casefold()
            if len(a) == len(b) == 1 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
        self.root = str.maketrans({c: find(c) for c in root})
        self._start()

    def _start(self) -> None:
        self.key = lru_cache(maxsize=500_000)(self._key)
        self.readings = lru_cache(maxsize=100_000)(self._readings)

    def __getstate__(self) -> dict:
        return {"forms": self.forms, "root": self.root}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def of(self, text: str | None) -> list[str]:
        return _WORD.findall(self.forms.letters(text)) if text else []

    def _key(self, word: str) -> int:
        first = word if word.isascii() else self.forms.readings(word)[0]
        return xxhash.xxh64_intdigest(first.casefold().translate(self.root)) - (1 << 63)

    def _readings(self, word: str) -> frozenset[str]:
        return frozenset(x.casefold() for x in self.forms.readings(word))

    def same(self, a: str, b: str) -> bool:
        return a == b or not self.readings(a).isdisjoint(self.readings(b))


def suffix_array(symbols: np.ndarray, n_symbols: int) -> np.ndarray:
    """Suffixes in order, by prefix doubling on ranks.

    The first order is that of as many symbols as fit into 62 bits; after that
    only suffixes that still share their rank with others are sorted again. A
    rank is the place of its group's first suffix, so ranks of finished
    suffixes stay as they are.
    """
    n, bits = len(symbols), max(1, int(n_symbols - 1).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(min(step, n)):
        key[: n - j] |= symbols[j:].astype(np.int64) << (bits * (step - 1 - j))
    order = np.argsort(key)
    rank, place = np.empty(n, np.int64), np.arange(n)
    first = np.concatenate(([True], np.diff(key[order]) != 0))
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    shared = order[~(first & np.concatenate((first[1:], [True])))]
    while len(shared):
        beyond = shared + step
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[shared] * (n + 1) + second
        by = np.argsort(key)
        shared, key, place = shared[by], key[by], np.arange(len(by))
        old = rank[shared]
        first = np.concatenate(([True], np.diff(key) != 0))
        start = np.maximum.accumulate(np.where(first, place, 0))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(old) != 0)), place, 0))
        rank[shared] = old + start - group
        shared = shared[~(first & np.concatenate((first[1:], [True])))]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    """Ranks of any symbol in a sequence, for many queries at once."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = symbols
        for b in reversed(range(self.bits)):
            bit = (s >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``i``."""
        lo, hi = np.zeros_like(i), i.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Over numbered words; symbol 0 ends a document and is in no pattern."""

    def __init__(self, bwt: np.ndarray, keep: np.ndarray, kept: np.ndarray, n_symbols: int):
        self.n, self.n_symbols = len(bwt), n_symbols
        self.bwt, self.keep, self.kept = bwt, keep, kept
        self.before = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=n_symbols))))
        self.tree = WaveletMatrix(bwt, n_symbols)
        self.kept_rank = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))

    @classmethod
    def of(cls, symbols: np.ndarray, n_symbols: int) -> FMIndex:
        sa = suffix_array(symbols, n_symbols)
        # kept: every SAMPLE-th position, and document starts, which a walk must not step over
        keep = (sa % SAMPLE == 0) | (symbols == 0)[sa - 1]
        return cls(symbols[sa - 1].astype(np.int32), keep, sa[keep].astype(np.int32), n_symbols)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern number, lo, hi) of the patterns that occur; one per row, equal lengths."""
        alive = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            c = patterns[alive, j]
            lo, hi = self.before[c] + self.tree.rank(c, lo), self.before[c] + self.tree.rank(c, hi)
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps, todo = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        out = np.empty(len(rows), np.int64)
        while len(todo):
            here = at[todo]
            hit = self.keep[here]
            out[todo[hit]] = self.kept[self.kept_rank[here[hit]]] + steps[todo[hit]]
            todo, here = todo[~hit], here[~hit]
            c = self.bwt[here]
            at[todo] = self.before[c] + self.tree.rank(c, here)
            steps[todo] += 1
        return out


class Shard:
    """Some documents and the FM-index of their words."""

    def __init__(self, docs: np.ndarray, starts: np.ndarray, keys: np.ndarray, vocabulary: list[str], words: np.ndarray, index: FMIndex):
        self.docs, self.starts, self.keys, self.vocabulary, self.words, self.index = docs, starts, keys, vocabulary, words, index

    @classmethod
    def of(cls, docs: list[tuple[int, list[str]]], compare: Words) -> Shard:
        """Word 0 of the vocabulary, and symbol 0 of the index, end a document."""
        number: dict[str, int] = {"": 0}
        starts = np.cumsum([0] + [len(w) + 1 for _, w in docs])
        words = np.zeros(starts[-1], np.int32)
        for s, (_, w) in zip(starts, docs):
            words[s : s + len(w)] = [number.setdefault(x, len(number)) for x in w]
        vocabulary = list(number)
        keys, symbol = np.unique(np.array([compare.key(x) for x in vocabulary[1:]], np.int64), return_inverse=True)
        symbols = np.concatenate(([0], symbol + 1))[words]
        return cls(np.array([k for k, _ in docs], np.int64), starts, keys, vocabulary, words, FMIndex.of(symbols, len(keys) + 1))

    def row(self) -> tuple:
        """As a row of INDEX, to be written."""
        i = self.index
        return (self.docs.tobytes(), self.starts.tobytes(), self.keys.tobytes(), self.vocabulary, self.words.tobytes(),
                i.bwt.tobytes(), np.packbits(i.keep).tobytes(), i.kept.tobytes())

    @classmethod
    def of_row(cls, row: tuple) -> Shard:
        docs, starts, keys, vocabulary, words, bwt, keep, kept = row
        read = lambda x, t: np.frombuffer(x, t)
        bwt, keys = read(bwt, np.int32), read(keys, np.int64)
        bits = np.unpackbits(read(keep, np.uint8), count=len(bwt)).astype(bool)
        return cls(read(docs, np.int64), read(starts, np.int64), keys, vocabulary, read(words, np.int32), FMIndex(bwt, bits, read(kept, np.int32), len(keys) + 1))

    def spans(self, items: Items, compare: Words) -> Iterator[tuple[int, int, int, int]]:
        """(doc, item, first word, number of words) of every leaked span."""
        n = items.n_words
        if not len(items.starts) or not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, items.keys), len(self.keys) - 1)
        symbols = np.where(self.keys[at] == items.keys, at + 1, 0)
        # windows of n words that all stand in this shard
        known = np.concatenate(([0], np.cumsum(symbols > 0)))
        starts = items.starts[known[items.starts + n] - known[items.starts] == n]
        if not len(starts):
            return
        which, lo, hi = self.index.search(symbols[starts[:, None] + np.arange(n)])
        if not len(which):
            return
        reps = hi - lo
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
        found, asked = self.index.locate(rows), np.repeat(starts[which], reps)
        same = np.fromiter((all(compare.same(self.vocabulary[self.words[p + j]], items.words[q + j]) for j in range(n))
                            for p, q in zip(found.tolist(), asked.tolist())), bool, len(found))
        found, asked = found[same], asked[same]
        doc = np.searchsorted(self.starts, found, side="right") - 1
        item = items.item_of[asked]
        held: list[int] | None = None
        for i in np.lexsort((found, item, doc)).tolist():
            d, k, p = int(doc[i]), int(item[i]), int(found[i] - self.starts[doc[i]])
            if held and held[:2] == [d, k] and p <= held[3]:
                held[3] = max(held[3], p + n)
                continue
            if held:
                yield int(self.docs[held[0]]), held[1], held[2], held[3] - held[2]
            held = [d, k, p, p + n]
        if held:
            yield int(self.docs[held[0]]), held[1], held[2], held[3] - held[2]


class Items:
    """A block of test items: their words one after the other, and where a
    passage of ``n_words`` successive words of one item begins."""

    def __init__(self, items: list[tuple[int, list[str]]], compare: Words, n_words: int = LEAK_WORDS):
        items = [(k, w) for k, w in items if len(w) >= n_words]
        self.n_words = n_words
        self.words = [x for _, w in items for x in w]
        self.keys = np.fromiter(map(compare.key, self.words), np.int64, len(self.words))
        self.item_of = np.repeat(np.array([k for k, _ in items], np.int64), [len(w) for _, w in items])
        left = np.concatenate([np.arange(len(w), 0, -1) for _, w in items]) if items else np.zeros(0, np.int64)
        self.starts = np.flatnonzero(left >= n_words)


_LONG, _BYTES, _TEXT = T.LongType(), T.BinaryType(), T.StringType()
SPANS = T.StructType([T.StructField(c, _LONG) for c in ("doc_id", "item_id", "first_word", "n_words")])
INDEX = T.StructType(
    [T.StructField(c, T.ArrayType(_TEXT) if c == "vocabulary" else _BYTES) for c in ("docs", "starts", "keys", "vocabulary", "words", "bwt", "keep", "kept")])


def leaked_spans(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str,
    n_words: int = LEAK_WORDS, shard_words: int = SHARD_WORDS, item_words: int = ITEM_WORDS,
) -> DataFrame:
    """Rows (doc_id, item_id, first_word, n_words): spans of at least ``n_words``
    successive words of an item in a document, as long as they can be merged.

    The items are the query set: they are searched in blocks of about
    ``item_words`` words, each sent to all tasks and dropped when it is done, so
    their number is not bounded by the driver. A shard is indexed once: where
    there are several blocks the indexes are written to the shared folder first.
    A document is in one shard, whatever its length. NULL and empty texts on
    either side and items shorter than ``n_words`` leak nothing; rows with a
    NULL key are left out; repeated documents are found each; texts are
    searched whole.
    """
    spark = docs.sparkSession
    compare = Words(standard_forms(spark))

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in rows:
            w = compare.of(t)
            if len(w) >= n_words:
                yield k, w, len(w)

    asked = T.StructType([T.StructField("item", _LONG), T.StructField("words", T.ArrayType(_TEXT)), T.StructField("n", _LONG)])
    known = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("bigint"), item_text)
    known = materialize(map_partition(known, read, asked), "items")
    blocks = max(1, -(-(known.agg(F.sum("n")).first()[0] or 0) // item_words))

    def shards(rows: Iterator[tuple]) -> Iterator[Shard]:
        shard, held = [], 0
        for k, t in rows:
            w = compare.of(t)
            if len(w) < n_words:
                continue
            shard.append((k, w))
            held += len(w) + 1
            if held >= shard_words:
                yield Shard.of(shard, compare)
                shard, held = [], 0
        if shard:
            yield Shard.of(shard, compare)

    corpus = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), text)
    index = materialize(map_partition(corpus, lambda rows: (s.row() for s in shards(rows)), INDEX, 1), "index") if blocks > 1 else None

    written, source = index is not None, corpus if index is None else index

    def search(b: int):
        mine = known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "words")
        block = spark.sparkContext.broadcast(Items([tuple(r) for r in mine.collect()], compare, n_words))

        def probe(rows: Iterator[tuple]) -> Iterator[tuple]:
            for shard in map(Shard.of_row, rows) if written else shards(rows):
                yield from shard.spans(block.value, compare)

        return block, map_partition(source, probe, SPANS)

    if not written:
        return search(0)[1]
    out = None
    for b in range(blocks):
        block, found = search(b)
        found = materialize(found, "spans")
        block.destroy()
        out = found if out is None else out.unionByName(found)
    discard(index)
    return out
