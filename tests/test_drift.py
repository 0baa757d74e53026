import datetime as dt
import itertools
import json
import random

from tracksift.operators.drift import field_changes, number_in, profiled_fields, unified
from tracksift.operators.matching import best_matching

SCHEMA = "run_no bigint, series string, written_at timestamp_ntz, results string, task string"


def runs(spark, files, series="s"):
    rows = [(i + 1, series, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), f if isinstance(f, (str, type(None))) else json.dumps({"t": f}), "clash") for i, f in enumerate(files)]
    return profiled_fields(spark.createDataFrame(rows, SCHEMA))


def changes(spark, files):
    return {(r.run_no, r.change_kind, r.old_field, r.new_field) for r in field_changes(runs(spark, files)).collect()}


def test_kinds(spark):
    files = [{"a": 1.0, "b": 5.0, "n": None}, "broken{", {"a": 1.0, "b2": [5.01], "c": 9.0}, {"a": None, "b2": [5.0], "d": 9.1},
             {"a": "1.0", "b2": {"value": 5.0}, "d": 9.1}, None, {"b2": {"value": 5.0}, "d": 9.1, "e": "N/A"}]
    assert changes(spark, files) == {
        (3, "removed", "b", ""), (3, "added", "", "b2"), (3, "added", "", "c"), (3, "removed", "n", ""), (4, "renamed", "c", "d"),
        (5, "retyped", "a", "a"), (5, "retyped", "b2", "b2"), (7, "removed", "a", ""), (7, "added", "", "e"),
    }
    assert changes(spark, [{"a": 1}]) == changes(spark, []) == set()


def test_field_that_comes_back(spark):
    assert changes(spark, [{"a": 1, "z": 0}, {"z": 0}, {"a": 3, "z": 0}]) == {(2, "removed", "a", ""), (3, "added", "", "a")}


def test_file_without_fields(spark):
    assert changes(spark, [{"a": 1, "b": 2}, {}, {"a": 1}, {}]) == {(2, "removed", "a", ""), (2, "removed", "b", ""), (3, "added", "", "a"), (4, "removed", "a", "")}
    assert changes(spark, [{}, {"a": 1}]) == {(2, "added", "", "a")} and changes(spark, [{}]) == set()
    fields = runs(spark, [{"a": 1}, {}, {"a": 1}])
    assert sorted(r.run_no for r in unified(fields, field_changes(fields)).collect()) == [1, 3]


def test_unified_follows_chains(spark):
    fields = runs(spark, [{"a": 1.0, "k": 7.5}, {"b": 1.0, "k": 7.5}, {"c": 1.01, "k": 7.5}, {"d": 1.0, "k": "7.5"}])
    rows = unified(fields, field_changes(fields)).collect()
    assert {(r.run_no, r.field, r.file_field) for r in rows if r.file_field != "k"} == {(1, "a", "a"), (2, "a", "b"), (3, "a", "c"), (4, "a", "d")}
    assert sorted(r.run_no for r in rows if r.field == "k") == [1, 2, 3, 4]


def test_number_in():
    assert [number_in(x) for x in (1, "2.5", " 3 ", [4], {"value": 5, "unit": "raw"}, "N/A", [], None, [1, 2], "nan")] == [1.0, 2.5, 3.0, 4.0, 5.0, None, None, None, None, None]


def test_matching_against_all_assignments():
    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        w = {(i, j): round(rng.random(), 2) for i in range(n) for j in range(m) if rng.random() < 0.6}
        got = best_matching(w, n, m)
        small, large = min(n, m), max(n, m)
        best = max((sum((i, j) in w for i, j in p), sum(w.get(x, 0) for x in p)) for p in (
            [(i, q[i]) if n <= m else (q[i], i) for i in range(small)] for q in itertools.permutations(range(large), small)))
        assert len(got) == best[0] and abs(sum(w[x] for x in got) - best[1]) < 1e-9
