"""Every registered query against its comparison SQL on the smallest tables."""

import math

import duckdb
import pytest

from loomstone import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def norm(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    got = df.collect()
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
