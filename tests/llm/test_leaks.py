import random

import numpy as np

from tracksift.llm.leaks import FMIndex, Items, Shard, WaveletMatrix, Words, leaked_spans, suffix_array
from tracksift.llm.lookalike import standard_forms


def test_suffix_array_and_index_against_brute_force():
    rng = np.random.default_rng(3)
    for n, k in ((1, 3), (40, 3), (600, 5)):
        s = rng.integers(1, k, n + 1)
        s[rng.random(n + 1) < 0.05] = 0
        s[-1] = 0
        assert list(suffix_array(s, k)) == sorted(range(n + 1), key=lambda i: list(s[i:]))
        tree = WaveletMatrix(s, k)
        c, i = rng.integers(0, k, 50), rng.integers(0, n + 2, 50)
        assert list(tree.rank(c, i)) == [int((s[:b] == a).sum()) for a, b in zip(c, i)]
        index = FMIndex.of(s, k)
        patterns = rng.integers(1, k, (60, 3))
        which, lo, hi = index.search(patterns)
        hits = {int(w): sorted(index.locate(np.arange(a, b))) for w, a, b in zip(which, lo, hi)}
        for w, p in enumerate(patterns):
            want = [i for i in range(n - 1) if list(s[i : i + 3]) == list(p)]
            assert hits.get(w, []) == want


def test_suffix_array_of_long_repeats():
    for s in ([1] * 300, [1, 2] * 200 + [0] + [1, 2] * 200, list(range(1, 40)) * 7 + [0]):
        x = np.array(s)
        assert list(suffix_array(x, 64)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_spans_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 30])))) for i in range(12)] + [(50, None), (51, ""), (None, "w1 " * 20)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab + ["other"]) for _ in range(rng.choice([0, 8, 60]))]
        for _ in range(rng.choice([0, 1, 2])):
            t = (rng.choice(items[:12])[1]).split()
            a = rng.randrange(len(t))
            w[len(w) // 2 : len(w) // 2] = t[a : a + rng.choice([5, 11, 12, 25])]
        docs.append((d, rng.choice([" ", "\n> ", ", "]).join(x.upper() if rng.random() < 0.3 else x for x in w), "x"))
    docs += docs[:5] + [(900, None, None), (901, "", None), (None, items[2][1], None), (902, "z " * 5000 + items[2][1], None)]
    n = 12
    words = Words(standard_forms(spark))
    leak_words = lambda t: [x.lower() for x in words.of(t)]
    want = set()
    for d, t, _ in docs:
        w = leak_words(t)
        for k, it in items:
            iw = leak_words(it)
            wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
            if d is not None and k is not None and any(tuple(w[i : i + n]) in wins for i in range(len(w) - n + 1)):
                want.add((d, k))
    dd = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    ii = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (400_000, 60):
        got = leaked_spans(dd, "doc_id", "text", ii, "item_id", "text", n, shard_words=200, item_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and all(r.n_words >= n for r in got)
    assert leaked_spans(dd.where("false"), "doc_id", "text", ii, "item_id", "text").count() == 0
    assert leaked_spans(dd, "doc_id", "text", ii.where("false"), "item_id", "text").count() == 0


ITEM = "Neither an early lift nor the muffled buzzer shows that some careful clockmaker could thread it"


def spans_of(spark, item, doc):
    words = Words(standard_forms(spark))
    shard = Shard.of([(7, words.of(doc)), (8, words.of("something else"))], words)
    items = Items([(1, words.of(item))], words)
    direct = list(shard.spans(items, words))
    assert list(Shard.of_row(shard.row()).spans(items, words)) == direct  # written and read again
    return direct


def test_hidden_differences_and_merging(spark):
    doc = "> Neither\u200b an EARLY lift nor\n> the muffled buzzer sh\u00adows that \u0455ome careful clockmaker"
    assert spans_of(spark, ITEM, "Before: " + doc) == [(7, 1, 1, 13)]


def test_items_in_texts_of_other_scripts(spark):
    russian = "\u041e\u043f\u0430, \u043e\u043d\u0430 \u043f\u043e\u0434\u043d\u044f\u043b\u0430 \u0441 \u043f\u043e\u043b\u0430 \u043b\u043e\u0436\u043a\u0443. "
    item = "So as a pace to see, no one can scope a sea of ice or copy a pace"  # words that could be Cyrillic whole
    assert spans_of(spark, item, russian * 5 + item)[0][3] == 18
    told = "\u0412\u0441\u0435 \u0440\u0430\u0432\u043d\u043e \u043e\u043d\u0430 \u0431\u0435\u0440\u0435\u0442 \u0441\u043e \u0441\u0442\u043e\u043b\u0430 \u0447\u0430\u0448\u043a\u0443 \u0438 \u043d\u0435\u0441\u0435\u0442 \u0435\u0435 \u043a \u043e\u043a\u043d\u0443"
    assert spans_of(spark, told, "It was said: " + told.upper())[0][3] == len(told.split())
    mixed = told.replace("\u0441", "c").replace("\u0430", "a")
    assert spans_of(spark, told, mixed)[0][3] == len(told.split())
    assert spans_of(spark, ITEM, ITEM.replace("nor", "or")) == [] and spans_of(spark, "", ITEM) == []


def test_keys_hold_equal_words_together(spark):
    words = Words(standard_forms(spark))
    for a, b in (("\u0412\u0421\u0415", "\u0432\u0441\u0435"), ("BCE", "\u0432\u0441\u0435"), ("\u0441\u043e", "CO"), ("\u13aa", "a"), ("caf\u0065\u0301", "CAF\u00c9")):
        (x,), (y,) = words.of(a), words.of(b)
        assert words.same(x, y) and words.key(x) == words.key(y)
    assert not words.same("now", "vow") and not words.same("your", "yoyr")
