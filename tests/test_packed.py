from hypothesis import given, settings
from hypothesis import strategies as st

from tracksift.operators.packed import Grammar, packed_values
from tracksift.plans.problems import qid_number

LABELS, QIDS = Grammar(False), Grammar(True)


def values(grammar, text):
    return [v for v, _ in grammar.parse(text)]


def test_separators_quotes_brackets():
    assert values(LABELS, 'reach@0;"idle, slow@1" | \'rest@2\'<SEP>x@3 / ;; y@4\n') == ["reach@0", "idle, slow@1", "rest@2", "x@3", "y@4"]
    assert values(LABELS, '["so-called ""reach""@1","a|b@2"]') == ['so-called "reach"@1', "a|b@2"]
    assert values(QIDS, "q3, q04 & 5 and 6 7\t8") == ["q3", "q04", "5", "6", "7", "8"]
    assert values(QIDS, "[1 | '2' ; \"3\"]") == ["1", "2", "3"]
    assert values(LABELS, "") == values(LABELS, " ; , ") == values(LABELS, '""') == []


def test_malformed_quotes_go_back_to_bare():
    assert LABELS.parse('"a@1;b@2') == [('"a@1', True), ("b@2", False)]
    assert LABELS.parse('"a"x@1;b@2') == [('"a"x@1', True), ("b@2", False)]


def test_brackets_are_slots_too():
    assert LABELS.parse("a@1;[b@2;(c@3 | {d@4})];e@5") == [(x, False) for x in ("a@1", "b@2", "c@3", "d@4", "e@5")]
    assert QIDS.parse("[1, 2], [3]") == [("1", False), ("2", False), ("3", False)] and QIDS.parse("[]; [ ] ;4") == [("4", False)]
    assert LABELS.parse('["x]@1", [y@2]]') == [("x]@1", False), ("y@2", False)]
    # unequal brackets: back to bare values, with a flag
    assert LABELS.parse("[a@1;b@2") == [("[a@1", True), ("b@2", False)] and LABELS.parse("a@1;b@2]") == [("a@1", False), ("b@2]", True)]
    assert LABELS.parse("(left) reach@1;x@2") == [("(left) reach@1", True), ("x@2", False)] and LABELS.parse("reach (left)@1") == [("reach (left)@1", False)]
    assert [v for v, bad in LABELS.parse("[a]b@1;c@2]") if bad] == ["a]b@1", "c@2"]
    assert values(LABELS, "[" * 40 + "a@1" + "]" * 40) == ["a@1"] and len(LABELS.parse("[" * 5000 + "a@1")) == 1 and LABELS.parse("[;" * 3000)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab,;|/\"' \t@1", min_size=1).map(str.strip).filter(bool), min_size=1, max_size=6), st.sampled_from([";", " | ", ", ", "<SEP>", "\n"]))
def test_quoted_values_round_trip(items, sep):
    packed = sep.join('"' + x.replace('"', '""') + '"' for x in items)
    assert values(LABELS, packed) == [x.strip() for x in items]


def test_rows_positions_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, "q1;2", ["a@1;b@2", None, "", "c@3"], "x"), (2, None, None, "y"), (None, "5", [], "z"), (3, "none", ["k" * 100000 + "@1"], None)],
        "sample_no bigint, qids string, filtered_resps array<string>, pos string")
    got = packed_values(df, "sample_no", {"qids": True, "filtered_resps": False}, {"qids": qid_number}).collect()
    rows = {(r.sample_no, r.field_name, r.pos, r.item_value) for r in got}
    assert rows == {(1, "qids", 0, "1"), (1, "qids", 1, "2"), (1, "filtered_resps", 0, "a@1"), (1, "filtered_resps", 1, "b@2"),
                    (1, "filtered_resps", 2, "c@3"), (None, "qids", 0, "5"), (3, "filtered_resps", 0, "k" * 100000 + "@1")}
    assert packed_values(df.where("false"), "sample_no", {"qids": True}).count() == 0
