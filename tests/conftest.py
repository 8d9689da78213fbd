import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lectern.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", cores=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Values of Columns over one row of the given columns."""

    def run(row: dict, schema: str, *columns):
        df = spark.createDataFrame([tuple(row.values())], schema)
        found = df.select(*columns).first()
        return found[0] if len(columns) == 1 else tuple(found)

    return run
