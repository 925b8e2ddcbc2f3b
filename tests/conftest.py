import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import check  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = check.session("4")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return session


@pytest.fixture(scope="session")
def small():
    return SMALL


def make_log(spark, rows):
    """Log from (asset, timestamp text, event id)."""
    data = [(a, datetime.fromisoformat(t), e, "R", "I", "M", a) for a, t, e in rows]
    return spark.createDataFrame(
        data, "asset_id string, ts timestamp, event_id long, region string, installation string, module string, equipment string"
    )


@pytest.fixture(scope="session")
def daily_log(spark):
    """One asset, one failure a day for 100 days."""
    start = datetime(2023, 1, 1)
    return make_log(spark, [("A", (start + timedelta(days=i)).isoformat(), i) for i in range(100)])


@pytest.fixture(scope="session")
def weekly_log(spark):
    """Three assets, 53 Sundays each."""
    start = datetime(2023, 1, 1)
    return make_log(spark, [
        (a, (start + timedelta(days=7 * i)).isoformat(), n * 100 + i) for n, a in enumerate("ABC") for i in range(53)
    ])
