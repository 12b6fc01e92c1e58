"""The pN_ queries that have SQL against DuckDB, over the smallest tables."""

import os

import pytest

from theoremlake.llm import oracle, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    want = rows(c.execute(oracle.oracle_sql()[name]).df())
    assert rows(queries.queries()[name](spark, DATA).toPandas()) == want and want
