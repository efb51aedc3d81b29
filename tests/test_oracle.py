"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from headcast.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        return str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(value(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
