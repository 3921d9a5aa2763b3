"""Every registered query of the reference's operators against its SQL."""

import pytest

import lodestone.plans  # noqa: F401
from lodestone.plans.registry import QUERIES, SQL

from .oracle import DATA, connection, rows


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got == rows(df.columns, QUERIES[name](spark, DATA).collect()), "the same in every run"
        return
    said = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(said.columns)
    assert got == rows(said.columns, said.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["author_id", "collab_score", "closest_seed"]
    assert set(e.oracle_sql()) <= set(e.queries())
