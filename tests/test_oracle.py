"""Every query with an oracle gives the rows that DuckDB gives for its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from manifestry.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def order(row):
    return [(x is None, "" if isinstance(x, (int, float)) else str(type(x)), 0 if x is None else x) for x in row]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    rel = duck.sql(catalog.oracle_sql()[name])
    own = list(rel.columns)
    assert sorted(own) == columns
    wanted = [tuple(plain(r[own.index(c)]) for c in columns) for r in rel.fetchall()]
    assert sorted(got, key=order) == sorted(wanted, key=order)
    assert got
