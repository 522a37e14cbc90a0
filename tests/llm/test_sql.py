"""Text operators that SQL can express, against their SQL."""

import pytest

from opsmetrics.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(name, spark):
    status, _, detail = compare(name, spark, duck(SF), SF, QUERIES, ORACLES)
    assert detail is None, f"{status}: {detail}"
