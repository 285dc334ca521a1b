"""Registered queries against their SQL on the smallest tables."""
import os

import duckdb
import pytest

from kassa.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols

    def rows(x):
        x = x[cols].astype(object)
        return sorted(map(repr, x.where(x.notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_every_operator_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
