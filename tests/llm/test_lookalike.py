import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracksift.llm.lookalike import LOOKALIKES, consistent_texts, lookalike_classes, lookalike_pairs, standard_forms

FROM_LATIN = {script: {pair[0]: pair[1] for pair in pairs.split()} for script, pairs in LOOKALIKES.items()}


def test_forms(spark):
    consistent_form = standard_forms(spark).form
    assert consistent_form("Ｆｕｌｌ １２") == "Full 12" and consistent_form("\ufb01n") == "fin"
    assert consistent_form("cafe\u0301") == consistent_form("caf\u00e9") == "caf\u00e9"
    assert consistent_form("a\u200bb\u00adc\ufeff") == "abc" and consistent_form("a\u00a0b\u2009c\u3000d") == "a b c d"
    assert consistent_form("re\u2011run") == "re-run" and consistent_form("x\r\ny") == "x\ny"
    assert consistent_form("рilot") == "pilot" and consistent_form("Тhе соmb") == "The comb"
    assert consistent_form("лoжкa") == "ложка" and consistent_form("Опa c ложкoй") == consistent_form("Опа с ложкой") == "Опа с ложкой"
    assert consistent_form("“x” – 3°") == "“x” – 3°" and consistent_form("και το δέντρο") == "και το δέντρο"
    assert (consistent_form(None), consistent_form(""), consistent_form("\u200b")) == (None, "", "")


def test_letters_of_any_script(spark):
    form = standard_forms(spark).form
    for disguised, meant in (("\u13aa", "A"), ("\u0251", "a"), ("\u03c1", "p"), ("\u03bd", "v"), ("\u03b1 = 3", "a = 3"), ("\ua4ee", "A")):
        assert form(disguised) == meant
    assert form("no nun on α β") == form("n\u043e nun on α β") == form("\u0578o nu\u0578 on a β")
    for a, b in (("A", "a"), ("I", "l"), ("l", "1"), ("O", "0"), ("rn", "m"), ("\u0131", "i"), ("\u03c3", "\u03bf"), ("\u4e00", "\u30fc"), ("в", "b"), ("v", "u")):
        assert form(a) != form(b)


def test_flags(spark):
    rows = [(1, "рilot", "x"), (2, "The соре", "x"), (3, "plain words", "x"), (4, None, "x"), (5, "", "x"), (6, "λx", None)]
    got = {r.doc_id: (r.form, r.n_mixed, r.n_whole) for r in consistent_texts(spark.createDataFrame(rows, "doc_id int, text string, form string"), "doc_id", "text").collect()}
    assert got == {1: ("pilot", 1, 0), 2: ("The cope", 0, 1), 3: ("plain words", 0, 0), 4: (None, 0, 0), 5: ("", 0, 0), 6: ("λx", 1, 0)}


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="abcdehijopsxyABCEHKMOPTXfglmnrtuзßøœ üéæ “”–…€°.,\n0127", max_size=40))
def test_the_short_way_gives_what_the_long_way_does(spark, text):
    forms = standard_forms(spark)
    if forms.plain(text):
        assert forms.long_form(text) == (text, 0, 0)
    assert forms.form(text) == forms.long_form(text)[0]


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="abcdehijopsxyABCEHKMOPTXfglmnrtuз дожЯé ü.,\n0α", max_size=40), st.randoms(use_true_random=False))
def test_disguises_come_back(spark, text, rng):
    consistent_form = standard_forms(spark).form
    want = consistent_form(text)
    assert consistent_form(want) == want
    out = []
    for c in text:
        swaps = [m[c] for m in FROM_LATIN.values() if c in m]
        x = rng.choice([c, *swaps]) if swaps else c
        if c == " ":
            x = rng.choice("   　")
        elif 33 <= ord(x) < 127 and rng.random() < 0.2:
            x = chr(ord(x) + 0xFEE0)
        elif rng.random() < 0.2:
            x = unicodedata.normalize("NFD", x)
        out.append(x + rng.choice(["", "", "​", "­", "⁠"]))
    assert consistent_form("".join(out)) == want


def test_pairs_and_classes(spark):
    rows = [(1, "same text", 0), (2, "ѕame text", 0), (3, "same text", 0), (4, "same text", 0), (5, "Same text", 0), (6, None, 0), (7, "", 0),
            (8, "​", 0), (9, "​​", 0), (None, "same text", 0)] + [(100 + i, "copied often", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, doc_id_a int")
    assert sorted(tuple(r) for r in lookalike_pairs(df, "doc_id", "text").collect()) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    got = {r.doc_id: tuple(r)[1:] for r in lookalike_classes(df, "doc_id", "text").collect()}
    assert got[2] == (1, 2, 4, 3) and got[4] == (1, 1, 4, 3) and got[5] == (5, 5, 1, 1) and got[399] == (100, 100, 300, 1)
    assert len(got) == 305 and lookalike_pairs(df.where("false"), "doc_id", "text").count() == 0


def test_a_form_of_many_texts_is_met_in_blocks(spark):
    texts = ["".join(c if i >> k & 1 else "\u200b" + c for k, c in enumerate("same1")) for i in range(32)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, "other"), (102, "\u043ether")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y and (a < 101) == (b < 101)}
    for block in (2000, 5, 1):
        got = [tuple(r) for r in lookalike_pairs(df, "doc_id", "text", block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
