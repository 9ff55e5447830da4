"""Every registered query against its SQL, on the smallest given tables, where they are there."""

import os

import pytest

import __spark_entry__ as entry
from treeloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names, order):
    at = [names.index(n) for n in order]
    return sorted((tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    q = duck.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(q.columns)
    assert plain(df.collect(), df.columns, order) == plain(q.fetchall(), q.columns, order)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
