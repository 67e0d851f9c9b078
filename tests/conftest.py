import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from seqtables.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8")


@pytest.fixture
def one(spark):
    """Value of a column expression."""
    return lambda column: spark.range(1).select(column.alias("v")).first().v
