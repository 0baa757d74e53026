import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracksift.plans import task as T
from tracksift.sources import logs as L
from tracksift.streaming import folds


def test_sample_logs(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good = json.dumps({"doc_id": 1, "target": "x", "filtered_resps": ["r"], "resps": [[[["t", "0", "1"]]]], "doc": {"k": 1}})
    (tmp_path / "a" / "one.jsonl").write_text(good + "\n{broken\n")
    with gzip.open(tmp_path / "two.jsonl.gz", "wt") as f:
        f.write(good)
    rows = L.read_samples(spark, str(tmp_path)).cache()
    assert rows.where("_corrupt_record IS NULL").count() == 2 and rows.where("_corrupt_record IS NOT NULL").count() == 1
    assert json.loads(rows.where("doc IS NOT NULL").first().doc) == {"k": 1}
    with pytest.raises(Exception):
        L.read_samples(spark, str(tmp_path), tolerant=False).collect()


def test_records_of_any_layout(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "y.json").write_text('noise {"a": 3}\n{"a": {broken\n{\n"a": 4}')
    assert sorted(r.a for r in L.read_records(spark, str(tmp_path), "a int").collect()) == [1, 2, 3, 4]


def test_newest_and_listing(spark, tmp_path):
    for name in ("m1/20240101_000000_samples.jsonl", "m1/20240301_000000_samples.jsonl", "m2/20230101_000000_samples.jsonl"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("{}")
    files = L.list_files(spark, str(tmp_path), "*_samples.jsonl")
    newest = {r.path.rsplit("/", 1)[-1] for r in L.newest_per_folder(files, "path", "modified").collect()}
    assert newest == {"20240301_000000_samples.jsonl", "20230101_000000_samples.jsonl"}


def test_csv_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", None), (2, "c", 0.5)], "k int, s string, v double")
    L.write_csv(df, str(tmp_path / "c"))
    assert sorted(L.read_csv(spark, str(tmp_path / "c"), "k int, s string, v double").collect()) == sorted(df.collect())
    (tmp_path / "bad.csv").write_text("k\nx\n")
    with pytest.raises(Exception):
        L.read_csv(spark, str(tmp_path / "bad.csv"), "k int").collect()
    L.write_jsonl(df, str(tmp_path / "j"))
    L.concat_jsonl(spark, [str(tmp_path / "j"), str(tmp_path / "j")], str(tmp_path / "jj"))
    assert spark.read.text(str(tmp_path / "jj")).count() == 4
    assert L.markdown_table(df.orderBy("k")) == "|k|s|v|\n|---|---|---|\n|1|a;b||\n|2|c|0.5000|\n"
    with pytest.raises(ValueError):
        L.markdown_table(df, 1)
    (tmp_path / "ids.txt").write_text("id\na\n\n b \n")
    assert [r.id for r in L.read_ids(spark, str(tmp_path / "ids.txt"), "id").collect()] == ["a", "b"]


def test_clip_times_and_templates(spark):
    rows = [("s:10.3,e:13.7",), ("s:1,e:2,s:5,e:6",), ("s:1,e:2,s:3",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.x and (round(r.x.t0, 3), round(r.x.t1, 3)) for r in df.select(L.clip_times(F.col("t")).alias("x")).collect()]
    assert got == [(10.2, 13.8), (4.9, 6.1), None, None, None]
    one = spark.createDataFrame([("a_b", None)], "f string, g string").select(L.template("<{{ f | regex_replace('_', '-') }}|{{g}}>").alias("x")).first()
    assert one.x == "<a-b|>"


def test_task_names():
    T.TASKS.setdefault("unit_a", None)
    T.TASKS.setdefault("unit_b", None)
    T.GROUPS.setdefault("unit_group", ["unit_?", "unit_inner"])
    T.GROUPS.setdefault("unit_inner", ["unit_b"])
    try:
        assert T.resolve(["unit_group"]) == ["unit_a", "unit_b"] and T.resolve(["nothing*"]) == []
        assert T.hierarchy("unit_group") == [(0, "unit_group"), (1, "unit_a"), (1, "unit_b"), (1, "unit_inner"), (2, "unit_b")]
        with pytest.raises(ValueError):
            T.register(T.TASKS, "unit_a")(None)
    finally:
        for r in (T.TASKS, T.GROUPS):
            for k in [k for k in r if k.startswith("unit_")]:
                del r[k]


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["click", "view", "error", "purchase", "view", "signup", "click"]
    for part in range(3):
        rows = [(part * 10 + i, f"2024-01-0{part + 1} 0{i}:00:00", i % 2, k, 1.0, None) for i, k in enumerate(kinds)]
        df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
        df.withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    got = {(r.user_id, r.event_id): r.motion for r in folds.run_to_table(folds.motion_stream(folds.stream_events(spark, str(tmp_path / "events"), 3)), "motion").collect()}
    want, on = {}, {}
    for r in events.orderBy("ts", "event_id").collect():
        on[r.user_id] = r.event_type != "view" if on.get(r.user_id) else r.event_type in ("click", "purchase")
        want[r.user_id, r.event_id] = on[r.user_id]
    assert got == want
    batch = folds.windowed_counts(events)
    stream = folds.run_to_table(folds.windowed_counts(folds.stream_events(spark, str(tmp_path / "events"), 1), late="1 hour"), "counts")
    closed = {tuple(r) for r in stream.collect()}
    assert closed and closed <= {tuple(r) for r in batch.collect()}
