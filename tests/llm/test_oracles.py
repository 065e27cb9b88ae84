"""The pN_ queries against their SQL, on the smallest test tables."""

import pytest

from reelspan.llm import queries
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_has_the_rows_of_its_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, DATA), duck, queries.oracle_sql()[name])


def test_every_problem_has_its_query():
    assert {f"p{n}_found" for n in range(1, 9)} <= set(queries.queries())


def test_p7_shares_add_up(spark):
    rows = queries.p7_shares(spark, DATA).collect()
    for mix in {r.mix_id for r in rows}:
        mine = [r for r in rows if r.mix_id == mix]
        if sum(r.got for r in mine):
            assert sum(r.actual_share for r in mine) == pytest.approx(1.0, abs=1e-4)
