"""Every registered query with SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

from karstwell.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(smoke):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{smoke}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, smoke, name):
    df = QUERIES[name](spark, smoke)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, smoke, name):
    assert QUERIES[name](spark, smoke).count() >= 0


def test_entry_has_the_rest():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert os.path.exists(__spark_entry__.__file__)
