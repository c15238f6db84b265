"""Queries of training-data pipelines against their SQL."""

import os

import duckdb
import pytest

from gaugeline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(repr, (tuple(x.item() if hasattr(x, "item") else x for x in r) for r in df[columns].itertuples(index=False, name=None))))
    assert rows(got) == rows(want)
