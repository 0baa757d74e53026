"""Queries of the reference's operators and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sql_mean(x: str) -> str:
    """SQL of the mean that doesn't depend on the order of rows."""
    return f"(sum(CAST({x} AS DECIMAL(28,12)))::DOUBLE / count({x}))"


def half_up(c: Column, places: int = 6) -> Column:
    """Rounded as SQL rounds a double: scaled, halves away from zero, scaled back."""
    scale = float(10**places)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def sql_draw(seed: int, part: str, *of: str) -> str:
    """SQL of ``sampling.draw``."""
    return f"('0x' || substr(md5('{seed}:{part}:' || " + " || ':' || ".join(of) + "), 1, 8))::BIGINT"
