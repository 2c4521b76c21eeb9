"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from perioda.plans import catalogue

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(rows, names):
    at = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: None if v is None else ("nan" if math.isnan(v) else repr(v)) if isinstance(v, float) else str(v)
    return sorted((tuple(cell(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    rel = db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert shown(rows, df.columns) == shown(rel.fetchall(), list(rel.columns))
