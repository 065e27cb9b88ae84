"""Each query against its SQL, on the smallest test tables."""

import pytest

from reelspan import oracle, queries
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_has_the_rows_of_its_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, DATA), duck, oracle.oracle_sql()[name])


def test_every_sql_belongs_to_a_query():
    assert set(oracle.oracle_sql()) <= set(queries.queries())
