"""Scans of the project's tables, with redelivered rows counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Key of each log whose rows may be delivered twice with the same content.
LOG_KEYS = {"label_track": "marker_id", "sample_log": "sample_no", "run_log": "run_no"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The raw table; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_rows(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``columns`` of a log, one row per key.

    A redelivery repeats key and content, so any of its rows serves; columns
    are chosen first to keep the shuffle by key narrow. The key is unique up to
    redelivery, so this shuffle can't be skewed.
    """
    key = LOG_KEYS[name]
    cols = list(dict.fromkeys((key, *columns)))
    return table(spark, sf_dir, name).select(*cols).dropDuplicates([key])
