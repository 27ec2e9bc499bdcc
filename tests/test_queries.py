"""Every registered query of the core against its SQL."""

import pytest

from rillmill.plans import registry
from tests.compare import DATA, assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, DATA).collect()
