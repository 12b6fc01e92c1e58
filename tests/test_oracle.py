"""Every core query that has SQL against DuckDB, over the smallest tables."""

import os

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def _rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def _names():
    from theoremlake.oracle import oracle_sql

    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_against_sql(spark, duck, name):
    from theoremlake import queries as Q

    assert _rows(Q.queries()[name](spark, DATA).toPandas()) == _rows(duck.execute(Q.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
