import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keelson.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        spark__master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="keelson-warehouse-"),
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as tuples, sorted so that nulls compare."""

    def get(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return get


@pytest.fixture
def table(spark):
    """A function that names a new table; the tables are dropped afterwards."""
    made = []

    def name():
        made.append(f"t{len(made)}_{os.urandom(4).hex()}")
        return made[-1]

    yield name
    for t in made:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
