import math

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.plans.catalogue import QUERIES
from corvane.plans.oracle import ORACLE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_queries_without_sql_run(spark, sf):
    for name in set(QUERIES) - set(ORACLE_SQL):
        QUERIES[name](spark, sf).count()


def test_no_query_leaks(spark, sf):
    assert QUERIES["leak_proof"](spark, sf).where("n_leaks > 0").count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() == 32
    assert set(entry.oracle_sql()) <= set(entry.queries())
