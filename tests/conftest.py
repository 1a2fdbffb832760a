import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from loreworks.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        app="tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-tests-", dir="/tmp"),
        },
    )
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""

    def get(df, *cols):
        return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())

    return get
