"""Every registered query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from framelake.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in ("embeddings", "events"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    a, b = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLE[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda df: df[cols].sort_values(cols).reset_index(drop=True).astype(float)
    assert (rows(a) - rows(b)).abs().max().max() < 2e-6 if len(a) else not len(b)
    assert len(a) == len(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
