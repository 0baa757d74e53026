"""Python over Arrow batches: rows in as tuples, rows out as typed batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in one output batch; keeps a worker's memory apart from the fan-out.
OUT_ROWS = 20_000


def batch_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns)) if batch.num_columns else iter(())


def to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def map_partition(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: T.StructType, size: int = OUT_ROWS) -> DataFrame:
    """``fn`` gets the rows of a partition as an iterator of tuples and gives
    the output rows, ``size`` to a batch; neither side is held whole unless
    ``fn`` does so."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from to_batches(fn(row for b in batches for row in batch_rows(b)), arrow, size)

    return df.mapInArrow(run, schema)
