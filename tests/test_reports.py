"""Every report runs, and those with SQL equal what DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from gaugeline import plans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def normal(df):
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        out[c] = [None if pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, float) else v for v in out[c].tolist()]
    return sorted(map(repr, out.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_report(spark, sql, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.ORACLES:
        assert len(got)
        return
    want = sql.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if want[c].dtype.kind == "f":
            got[c] = got[c].astype(float)
        elif want[c].dtype.kind in "iu" and got[c].dtype.kind == "f":
            want[c] = want[c].astype(float)
    assert normal(got) == normal(want)
