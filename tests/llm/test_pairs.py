import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracksift.llm.languages import LanguageModel, language_name, main_script, split_words, train_languages
from tracksift.llm.lookalike import standard_forms
from tracksift.llm.pairs import Defects, answer_segments, compile_grammar, is_copy, is_truncated, pair_defects, tiles

DOCS = Path("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(spark):
    if not DOCS.exists():
        pytest.skip("no labelled texts here")
    return train_languages(spark.read.parquet(str(DOCS)), "text", language_name(F.col("lang")))


@pytest.fixture(scope="module")
def defect(spark, model):
    return lambda answer, prompt, labels=frozenset(): Defects(standard_forms(spark), model, labels).of(answer, prompt)


PROMPT = "Watch the 8 frames and say which daily activity the person is doing. Think about the objects first. End with a line FINAL_ANSWER: followed by one name."
GERMAN = "Betrachte die 8 Bilder und nenne die Tätigkeit, die die Person gerade ausführt. Begründe kurz und schließe mit FINAL_ANSWER: und dem Namen."
FINE = "The left hand lifts a mug and the elbow stays bent. I am unable to see frame 3 in full, but the path is short.\nFINAL_ANSWER: drinking"


@pytest.mark.parametrize(("answer", "prompt", "want"), [
    (FINE, PROMPT, None), ("The right hand turns a jar. So this is jarlid.", PROMPT, None),
    ("You ask: Watch the 8 frames and say. " + FINE, PROMPT, None), (PROMPT + " " + FINE, PROMPT, None),
    (None, PROMPT, "empty"), (" ​ ", PROMPT, "empty"), ("N/A", PROMPT, "empty"), ("[invalid]", PROMPT, "empty"), ("...", PROMPT, "empty"),
    ("The left hand lifts a", PROMPT, "truncated"), ("The left hand lifts a mug …", PROMPT, "truncated"), ("The hand is still.\nFINAL_AN", PROMPT, "truncated"),
    ("The hand is still.\nFINAL_ANSWER:", PROMPT, "truncated"), ("The hand is still.\nFINAL_ANSWER: drin", PROMPT, "truncated"),
    ("The hand is still.\nFINAL_ANSWER: \"drinking", PROMPT, "truncated"),
    ("I'm sorry, but I cannot assist with that request.", PROMPT, "refusal"), ("My guidelines keep me from scoring these frames, so I must decline.", PROMPT, "refusal"),
    ("Es tut mir leid, dabei kann ich nicht helfen.", GERMAN, "refusal"),
    (PROMPT, PROMPT, "copy"), ("Question: " + PROMPT.lower(), PROMPT, "copy"), (PROMPT + "\n" + PROMPT, PROMPT, "copy"), (PROMPT[:67], PROMPT, "copy"),
    ("La main gauche a lâché la tasse après 3 secondes, car la lumière baissait.\nFINAL_ANSWER: drinking", PROMPT, "other_language"),
    ("Участник поднял ложку с трудом.\nFINAL_ANSWER: drinking", PROMPT, "other_language"),
    ("Die linke Hand hielt das Glas, weil der Ärmel störte.", GERMAN, None), (FINE, GERMAN, "other_language"), (FINE, None, None), ("", None, "empty"),
])
def test_defects(defect, answer, prompt, want):
    assert defect(answer, prompt, frozenset(["drinking", "jarlid"])) == want


HINDI, CHINESE = "हाथ धीरे से कप उठाता है और मेज पर रखता है।", "左手慢慢地举起杯子。"


@pytest.mark.parametrize(("answer", "prompt", "other"), [
    (HINDI, PROMPT, True), ("হাত ধীরে কাপ তোলে।", PROMPT, True), ("கை மெதுவாக கோப்பையை தூக்குகிறது.", PROMPT, True), ("มือยกถ้วยขึ้นช้าๆ", PROMPT, True),
    ("ხელი ნელა ასწევს ჭიქას.", PROMPT, True), ("Ձեռքը դանդաղ բարձրացնում է բաժակը։", PROMPT, True), ("היד מרימה את הכוס.", "ترفع اليد الكوب ببطء؟", True),
    (CHINESE, "手がゆっくりコップを持ち上げるか。", True), ("손이 천천히 컵을 든다.", CHINESE, True), ("右手拿着杯子。", CHINESE, False), (CHINESE, PROMPT, True), ("Да.", PROMPT, True),
    (PROMPT[:40] + " β. " + FINE, PROMPT, False), (FINE, HINDI, True), ("कप मेज पर है और हाथ स्थिर है।", HINDI, False), ("Der Winkel α ist klein und das Glas steht.", GERMAN, False),
])
def test_scripts(defect, answer, prompt, other):
    assert (defect(answer, prompt) == "other_language") is other


def test_pushdown():
    assert is_truncated("See `x` and **bold** text:\n```\ncode") and not is_truncated("Done:\n```\ncode\n```")
    assert is_truncated("He said \"stop it.") and not is_truncated("He said \"stop it.\"")
    assert not is_truncated("Signs:\n- bent elbow\n- short path") and is_truncated("It stays (as in frame 3.")
    assert not is_truncated("yes") and not is_truncated("2")


@pytest.mark.parametrize(("answer", "want"), [
    ("Signs:\n- bent elb", True), ("1. The hand lifts a", True), ("Signs:\n- bent elbow\n- short path of the", True), ("Signs:\n- bent elbow,\n- short path,", True),
    ("Signs:\n- The elbow is bent.\n- The path is sho", True), ("Signs:\n- an elbow\n- the left elb", True), ("Schritte:\n1) Glas heben\n2) Glas und", True),
    ("Signs:\n- bent elbow\n- short frames", False), ("1. The hand lifts a mug.", False), ("- mug\n- drinking", False), ("Steps:\n* lift (slow)\n* drop (fast)", False), ("Scores:\n- 1\n- 2", False),
    ("The **hand is still.", True), ("See `x is set.", True), ("So <b>the hand rests.", True), ("The **hand** is <b>`x`</b> still.", False),
    ("It doesn`t move.", False), ("It is 2 ** 3 or 2**3.", False), ("One.<br>Two.", False),
])
def test_list_items_and_markup(answer, want):
    assert is_truncated(answer, frozenset(["drinking"]), PROMPT) == want


def test_tiles_cover_long_texts_and_repeats():
    p = "a b c d e".split()
    assert tiles("x a b c y d e".split(), p) == [False, True, True, True, False, False, False]
    assert all(tiles(p + p, p)) and tiles([], p) == [] and not any(tiles(p, []))
    assert is_copy("word " * 100_000, "word " * 40) and is_copy("word " * 50_000, "word " * 50_000)


def greedy_tiles(a, p):
    """By definition: the longest common stretch of unmarked words, leftmost first, then the rest against the whole prompt."""
    a, left, asked = list(a), list(a), list(p)
    while True:
        found = [(k, -i, j) for k in range(3, len(p) + 1) for i in range(len(a) - k + 1) for j in range(len(p) - k + 1)
                 if None not in left[i : i + k] and left[i : i + k] == asked[j : j + k]]
        if not found:
            return left
        k, i, j = max(found)
        left[-i : -i + k] = asked[j : j + k] = [None] * k


def test_tiles_against_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        a, p = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        known = {tuple(p[i : i + k]) for k in range(3, len(p) + 1) for i in range(len(p) - k + 1)}
        first = greedy_tiles(a, p)
        got = tiles(a, p)
        marked = [x is None for x in first]
        # as many words in tiles of both texts (ties between places may differ), then what is left is offered the prompt again
        assert sum(got) >= sum(marked)
        end = 0
        while end < len(got):
            run = end
            while run < len(got) and not got[run]:
                run += 1
            assert not any(tuple(a[i : i + k]) in known for i in range(end, run) for k in range(3, run - i + 1))
            end = run + 1
    distinct = "a b c d e f g h i j k l".split()
    for _ in range(200):
        p = rng.sample(distinct, 12)
        a = [x for j in rng.sample(range(10), 3) for x in p[j : j + rng.randint(2, 6)]]
        assert all(y for x, y in zip(greedy_tiles(a, p), tiles(a, p)) if x is None)
        assert tiles(p, p) == [True] * 12 and tiles(["x", *p[3:7], "x"], p) == [False, True, True, True, True, False]


def test_grammars():
    g = compile_grammar({"s": ["<who>? <does> not", "stop"], "who": ["i", "we"], "does": ["do", "will"]}, "s")
    assert all(g.search(x) for x in ("we do  not go", "Will not", "do stop", "I will\nnot")) and not any(g.search(x) for x in ("i not", "doing not", "unstopped sto"))
    with pytest.raises(ValueError):
        compile_grammar({"s": ["<s>"]}, "s")


@pytest.mark.parametrize(("answer", "want"), [
    # written after the limits were set, on other sentences
    ("Kobieta trzyma nożyczki i powoli tnie papier na małe kawałki.", True), ("Nainen leikkaa paperia saksilla ja hymyilee samalla ystävälleen.", True),
    ("Kvinnan klipper papperet med saxen och ler samtidigt mot sin vän.", True), ("Kadın makasla kağıdı keser ve aynı anda arkadaşına gülümser.", True),
    ("De vrouw knipt het papier met een schaar en lacht ondertussen naar haar vriendin.", True), ("A mulher corta o papel com a tesoura enquanto sorri para a amiga.", True),
    ("Žena stříhá papír nůžkami a přitom se usmívá na svou kamarádku.", True), ("Az asszony ollóval vágja a papírt, miközben a barátnőjére mosolyog.", True),
    ("Perempuan itu menggunting kertas sambil tersenyum kepada temannya.", True), ("Femeia taie hârtia cu foarfeca și îi zâmbește prietenei sale.", True),
    ("Die Frau schneidet Papier mit der Schere und lächelt dabei ihrer Freundin zu.", True), ("La mujer corta el papel con las tijeras y sonríe a su amiga.", True),
    ("Женщина режет бумагу ножницами и улыбается подруге.", True), ("Η γυναίκα κόβει χαρτί με το ψαλίδι.", True),
    ("Somebody keeps cutting paper with scissors while smiling at her friend across the room.", False),
    ("Judging from posture alone, our volunteer seems tired but otherwise comfortable.", False),
    ("Both elbows hover above the counter; nothing else changes until the kettle whistles.", False),
])
def test_languages_not_seen_while_writing(defect, answer, want):
    assert (defect(answer, PROMPT) == "other_language") is want


def test_models_of_few_texts(spark):
    df = spark.createDataFrame([("the hand is still " * 3 + str(i), "EN-us ") for i in range(6)] + [("die hand", "de"), (None, "en"), ("", "en"), ("x", None)], "text string, lang string")
    m = train_languages(df, "text", language_name(F.col("lang")))
    assert set(m.counts) == {"en"} and m.best(["the"]) == "en" and "hand" in m.words
    none = train_languages(df.where("false"), "text", language_name(F.col("lang")))
    assert none.best(["the"]) is None and not none.other(["the"], ["der"]) and isinstance(none, LanguageModel)
    assert main_script("да no да") == "CYRILLIC" and main_script("12 .") is None and split_words("It's 3 o’clock") == ["it's", "o’clock"]


def test_rows(spark, model):
    schema = "sample_no bigint, input string, resps array<array<array<array<string>>>>, filtered_resps array<string>, defect string"
    rows = [
        (1, PROMPT, [[[[FINE, "0", "1"], ["", "1", "2"]]]], None, "x"), (2, PROMPT, None, [f"<RESP> {FINE} <TIME> 0-1 <resp>  <time> 1-2 "], None),
        (3, PROMPT, [], ["[invalid]"], None), (4, PROMPT, [[]], None, None), (5, PROMPT, [[[[None, "0", "1"]], [[FINE, "0", "1"]]], None], [], None), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in pair_defects(df, "sample_no", "input", answer_segments(F.col("resps"), F.col("filtered_resps")), model).collect()}
    assert got == {(1, 1, "empty"), (2, 1, "empty"), (3, 0, "empty"), (4, 0, "empty"), (5, 0, "empty"), (None, 0, "empty")}
    assert pair_defects(df.where("false"), "sample_no", "input", F.lit(None).cast("array<string>"), model).count() == 0
