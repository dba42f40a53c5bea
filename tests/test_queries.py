"""Each query with SQL against DuckDB, on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from catalogsmith.plans import catalog_queries, record_queries
from catalogsmith.plans.views import TABLES

OWN = record_queries.QUERIES | catalog_queries.QUERIES
SQL = record_queries.ORACLES | catalog_queries.ORACLES


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(x):
    return None if x is None or x != x else round(float(x), 4) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, data, duck, name):
    df = OWN[name](spark, data)
    names = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name in SQL:
        result = duck.execute(SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == names
        theirs = [tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall()]
        assert sorted(ours, key=str) == sorted(theirs, key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
