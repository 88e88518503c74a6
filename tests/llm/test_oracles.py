import os

import pytest

from ledgerlark.llm.registry import ORACLES, QUERIES
from tests.oracle import SF_DIR, same


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_all_thirteen_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
