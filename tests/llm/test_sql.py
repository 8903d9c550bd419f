"""The text operators' queries against their SQL on the smallest tables."""

import pytest

from eigenloom.llm import queries
from tests.checks import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    want = duck(SF).execute(queries.oracle_sql()[name])
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in want.description], want.fetchall())
