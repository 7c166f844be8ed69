"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from pairweave.plans import ORACLES, QUERIES

D = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{D}/{t}.parquet"
        c.sql(f"create view {t} as from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def rows(frame):
    def plain(x):
        if x is None or (not isinstance(x, str) and pd.isna(x)):
            return (0, 0.0)
        if isinstance(x, str):
            return (2, x)
        x = x.item() if hasattr(x, "item") else x
        return (1, round(float(x), 6)) if isinstance(x, (int, float, bool)) else (2, str(x))

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, D).toPandas()
    assert len(got)
    if name in ORACLES:
        want = con.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        g, w = rows(got), rows(want)
        assert len(g) == len(w)
        for a, b in zip(g, w):
            assert all(x == y or (x[0] == y[0] == 1 and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=1.5e-6)) for x, y in zip(a, b)), (a, b)
