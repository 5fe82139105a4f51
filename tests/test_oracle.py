"""Every registered query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from colloquy.plans.catalog import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITH_SQL = sorted(n for n, (_, sql) in registry().items() if sql)
WITHOUT = sorted(n for n, (_, sql) in registry().items() if not sql)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "isoformat"):
        return str(value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(spark, sf, duck, name):
    run, sql = registry()[name]
    df = run(spark, sf)
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(spark, sf, name):
    assert registry()[name][0](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
