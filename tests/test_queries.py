"""Every registered library query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from corpusgrid.plans.catalogue import ORACLE, QUERIES


def canonical(frame):
    def cell(v):
        if not isinstance(v, (list, tuple, dict)) and not hasattr(v, "shape") and pd.isna(v):
            return ""
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, row)) for row in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
