"""Every registered query of the library against its SQL; those without SQL must give rows."""

import pytest
from learnmill.plans.queries import ORACLES, QUERIES
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert not differences(df, ORACLES[name], sf_dir)
    else:
        assert df.columns and df.count() >= 0
