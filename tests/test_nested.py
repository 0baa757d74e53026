import json

from tracksift.operators.nested import flat_table, read_table, tagged_rows, write_tables

CONFIG = {
    "t": {"task": "t", "metric_list": [{"metric": "acc", "args": {"a": 1}}, "rce"],
          "filter_list": {"name": "f", "filter": ["lower", {"function": "regex", "regex_pattern": "x"}]}},
    "g": {"group": "g", "task": json.dumps([{"task": "t_s0", "metric_list": {"0": "m0", "1": {"metric": "m1"}}}, "plain"])},
    "s": json.dumps({"task": "s", "metric_list": json.dumps([{"metric": "q"}]), "filter_list": [{"name": "n"}]}),
}
ROWS = [
    (1, json.dumps({"t": {"alias": "t", "a,none": 1.5, "b": None}}), json.dumps(CONFIG), "x"),
    (2, '{"t": {"alias"', None, "x"), (3, None, "", "x"), (4, "[]", "[1]", None), (None, json.dumps({"t": {"z": 1}}), "null", None),
]


def tagged(spark):
    return tagged_rows(spark.createDataFrame(ROWS, "run_no bigint, results string, configs string, task string"))


def test_rows(spark):
    got = {(r.run_no, r.task, r.tag, r.parent_pos, r.pos, r.entry_name) for r in tagged(spark).collect()}
    assert got == {
        (1, "t", "score", -1, -1, "alias"), (1, "t", "score", -1, -1, "a,none"), (1, "t", "score", -1, -1, "b"),
        (1, "t", "metric", -1, 0, "acc"), (1, "t", "metric", -1, 1, "rce"), (1, "t", "filter", -1, 0, "f"),
        (1, "t", "step", 0, 0, "lower"), (1, "t", "step", 0, 1, "regex"), (1, "g", "subtask", -1, 0, "t_s0"),
        (1, "g", "subtask", -1, 1, "plain"), (1, "t_s0", "metric", -1, 0, "m0"), (1, "t_s0", "metric", -1, 1, "m1"),
        (1, "s", "metric", -1, 0, "q"), (1, "s", "filter", -1, 0, "n"), (None, "t", "score", -1, -1, "z"),
    }


def test_links_and_round_trip_through_files(spark, tmp_path):
    rows = tagged(spark)
    write_tables(rows, str(tmp_path / "t"))
    steps = read_table(spark, str(tmp_path / "t"), "step").collect()
    filters = {r.row_key: r.entry_name for r in flat_table(rows, "filter").collect()}
    assert {filters[r.parent_key] for r in steps} == {"f"} and {r.regex_pattern for r in steps} == {None, "x"}
    subs = {r.row_key for r in flat_table(rows, "subtask").collect()}
    assert {r.parent_key for r in flat_table(rows, "metric").where("task = 't_s0'").collect()} <= subs
    assert tagged_rows(spark.createDataFrame([], "run_no bigint, results string, configs string")).count() == 0
