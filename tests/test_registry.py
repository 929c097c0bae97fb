import pytest

import ledgerloom.plans.registry as registry
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_the_oracle(spark, con, name):
    assert differences(spark, con, SF, registry.QUERIES[name], registry.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_oracle(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
