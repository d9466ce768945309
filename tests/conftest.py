import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from racecard.operators import skew  # noqa: E402
from racecard.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def small_groups_are_hot(spark):
    """Every key above a thousandth of the rows is treated as too large for one task."""
    spark.conf.set(skew.PARTS_SETTING, "1000")
    yield
    spark.conf.unset(skew.PARTS_SETTING)


@pytest.fixture
def one(spark):
    """Value of one column expression on one row of text."""

    def run(value, make):
        df = spark.createDataFrame([(value,)], "c string")
        return df.select(make("c").alias("v")).first()["v"]

    return run


def day(n: int) -> dt.date:
    return dt.date(2023, 1, 1) + dt.timedelta(days=n)
