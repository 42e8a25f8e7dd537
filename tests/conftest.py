import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roaskit.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[8]", 4, **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def channels_400d(spark):
    """400 days of three channels in closed form: a weekly pattern of spend, a return that falls as spend rises."""
    pattern = (1.0, 1.1, 1.2, 1.1, 1.0, 0.8, 0.8)
    rows = []
    for ch, level, worth in (("Google Ads", 640, 5.0), ("Meta Ads", 280, 3.5), ("Bing Ads", 90, 2.0)):
        for i in range(400):
            spend = level * pattern[i % 7] * (1 + (i % 50) / 500)
            revenue = worth * spend * (1.1 - 0.1 * pattern[i % 7])
            rows.append((dt.date(2023, 3, 6) + dt.timedelta(days=i), ch, spend, revenue, 12.0, 150.0))
    return spark.createDataFrame(
        rows, "date date, channel string, spend double, revenue double, clicks double, impressions double"
    ).cache()


@pytest.fixture
def make_series(spark):
    """A one-entity series out of (date, revenue, spend) rows."""
    def make(rows, kind="Channel", value="X"):
        return spark.createDataFrame(
            [(kind, value, d, float(r), float(s)) for d, r, s in rows],
            "dimension_type string, dimension_value string, date date, revenue double, spend double")
    return make
