"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from vellumflow.plans.registry import FLAGSHIP, QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 7)
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def same(df, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: repr([normal(row[c]) for c in sorted(names)])
    assert sorted(key(dict(zip(names, r, strict=True))) for r in want.fetchall()) == sorted(key(r.asDict(recursive=True)) for r in df.collect())


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, DIR), SQL[name])


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
