"""Each query that SQL can express returns what its SQL returns on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF_DIR, assert_same

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    assert_same(queries.queries()[name](spark, SF_DIR), duck.sql(queries.oracle_sql()[name]))
