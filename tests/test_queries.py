"""Each query against its SQL on the same tables."""

from collections import Counter

import duckdb
import pytest

from refloom.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*want.columns).collect())
    assert got == Counter(tuple(map(plain, r)) for r in want.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
