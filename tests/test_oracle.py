"""Every registered query with oracle SQL equals DuckDB on the smallest scale factor."""
import pytest

from conftest import SF_SMALL
from helpers import rows
from kassa.plans.registry import load_all

REG = load_all()
SQL_QUERIES = sorted(n for n, q in REG.items() if q.sql is not None)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_matches_oracle(spark, duck, name):
    q = REG[name]
    sp = q.run(spark, SF_SMALL).toPandas()
    dp = duck.execute(q.oracle()).df()
    assert list(sp.columns) == list(dp.columns)
    assert rows(sp) == rows(dp)


def test_entry_contract(spark):
    import __spark_entry__ as e
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    df = e.entry(spark)
    assert df.count() > 0
    assert "spend" in df.columns
