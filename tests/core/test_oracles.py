import os

import pytest

from ledgerlark.plans import filing_queries, model_queries  # noqa: F401 - they register their queries
from ledgerlark.plans.registry import ORACLES, QUERIES
from tests.oracle import SF_DIR, same


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
