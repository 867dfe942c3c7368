"""Each registered query returns what its SQL returns on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF_DIR, assert_same

from millrace.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF_DIR)
    if name in registry.ORACLES:
        assert_same(frame, duck.sql(registry.ORACLES[name]))
    else:
        frame.collect()
