"""Every query with SQL against DuckDB, over the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from tracksift.plans import catalog, catalog_choices, catalog_files, catalog_frames, catalog_harness, catalog_metrics, catalog_more, catalog_sequences, catalog_tasks, catalog_text, problems  # noqa: F401

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
ORACLES = catalog.ORACLES | problems.ORACLES
QUERIES = catalog.QUERIES | problems.QUERIES


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 6) + 0.0 if not isinstance(v, int) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
