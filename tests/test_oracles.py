"""Every query with SQL gives the same rows as that SQL on the smallest tables."""

import duckdb
import pytest

from lumenframe.plans import files, queries

TABLES = "part embeddings pages nation".split()
QUERIES, ORACLES = queries.QUERIES | files.QUERIES, queries.ORACLES | files.ORACLES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    a, b = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
