import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from troughline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Small tables: make("a string, b double", [...])."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)
