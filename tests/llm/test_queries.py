"""The queries of this subpackage that SQL can express, against their SQL."""

import pytest

from rillmill.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])
