"""Every registered query against its SQL on the smallest tables."""

import pytest
from checking import DATA, compare, connect

from seqtables.catalog import ORACLES, QUERIES

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 2
    assert set(contract.oracle_sql()) <= set(contract.queries())
