"""Streams: keyed state over late data, and windowed counts.

Both are twins of batch operators: run over a finished stream they give what
the batch gives. State is kept per key by ``transformWithState``, rows are
dropped as late only past the watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tracksift.functions.times import ntz_ms
from tracksift.session import shared_dir

OUT = StructType([StructField("user_id", LongType()), StructField("event_id", LongType()), StructField("motion", BooleanType())])
#: transformWithState needs several state columns per key, which this store has.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


class FlagState(StatefulProcessor):
    """A flag per key that kinds of ``starts`` turn on and, once on, kinds of ``ends`` off."""

    def __init__(self, starts: frozenset[str], ends: frozenset[str]):
        self.starts, self.ends = starts, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.on = handle.getValueState("on", StructType([StructField("on", BooleanType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:  # noqa: N802 (the API's name)
        on = bool(self.on.get()[0]) if self.on.exists() else False
        data = pd.concat(list(rows)).sort_values(["t", "event_id"])
        states = []
        for kind in data["event_type"]:
            on = kind not in self.ends if on else kind in self.starts
            states.append(on)
        self.on.update((on,))
        yield pd.DataFrame({"user_id": [key[0]] * len(data), "event_id": data["event_id"].to_numpy(), "motion": states})

    def close(self) -> None:
        pass


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def motion_stream(events: DataFrame, starts: tuple[str, ...] = ("click", "purchase"), ends: tuple[str, ...] = ("view",)) -> DataFrame:
    """(user_id, event_id, motion) per event: motion starts at a kind of ``starts``
    and, once on, ends at one of ``ends``.

    Events of one user should come in order from batch to batch, within a batch
    they are sorted; one that comes in a later batch than it should is judged by
    the state there is by then, and counts from then on."""
    rows = events.select("user_id", "event_id", ntz_ms(F.col("ts")).alias("t"), "event_type")
    return rows.groupBy("user_id").transformWithStateInPandas(FlagState(frozenset(starts), frozenset(ends)), OUT, "Append", "None")


def _at(events: DataFrame, late: str) -> DataFrame:
    """``events`` with the instant its zoneless time names in UTC (a watermark needs
    one), so windows don't move with the session's zone."""
    at = events.withColumn("at", F.timestamp_millis(ntz_ms(F.col("ts"))))
    return at.withWatermark("at", late) if events.isStreaming else at


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start_ms, event_type, n, total) per tumbling window, for streams and batches."""
    counts = _at(events, late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(user_id, start_ms, end_ms, n) per session of a user."""
    counts = _at(events, late).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there (``availableNow``) into a table of the shared
    folder, with its checkpoint beside it, and returns a scan of the table."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sink = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-progress").option("path", path)
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(stream.schema).parquet(path)


def run_to_whole_table(stream: DataFrame, label: str) -> DataFrame:
    """Runs an aggregation over what is there and returns its whole result, open
    windows too: each batch writes the result so far as a table of its own, and the
    last one counts."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    last: list[int] = []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{batch}")
        last[:] = [batch]

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[0]}")
