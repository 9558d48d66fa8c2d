"""Every core query that SQL can express equals its SQL; the others run and have a stable schema."""

import pytest

from codelens.plans import registry
from tests.parity import DATA, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    compare(spark, con, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    assert all(tuple(r.__fields__) == tuple(df.columns) for r in rows[:3])


def test_sql_has_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
