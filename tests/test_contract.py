"""Every query with SQL beside it equals that SQL on the smallest tables."""

import duckdb
import pytest

from contract import check, fixtures, registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    link = duckdb.connect()
    link.execute("set timezone='UTC'")
    for name in fixtures.TABLES:
        link.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    return link


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.collect(), df.columns) == check.rows_of(result.fetchall(), columns)


def test_every_rows_only_query_is_named():
    """Queries without SQL are few and each is covered by a test of its own elsewhere."""
    assert set(registry.QUERIES) - set(SQL) == {
        "d1_split_rank_blake2b", "m1_pixel_classifier", "m2_self_training",
    }


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
