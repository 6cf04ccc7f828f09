import pytest
from learnmill.llm.queries import ORACLES, QUERIES
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    assert not differences(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)
