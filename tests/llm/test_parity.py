"""The training-data queries that SQL can express equal their SQL."""

import pytest

from codelens.llm import queries
from tests.parity import DATA, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, con, name):
    compare(spark, con, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["p1_contributors", "p2_rates", "p4_kinds", "p5_shares", "p8_ids", "p9_shares", "p10_pieces"])
def test_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0
