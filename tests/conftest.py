import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session

    session = local_session(4, partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame(schema, *rows)``: a small table."""

    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make


def tuples(df, *columns):
    """Sorted rows of a table."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
