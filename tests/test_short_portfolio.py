import datetime as dt

import pytest

from roaskit.plans import forecasting


@pytest.mark.parametrize("days", [1, 4, 5, 6])
def test_a_portfolio_of_few_days_is_forecast(spark, days):
    """Every entity has its rows, however short the history; the portfolio never falls back on itself."""
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "Google Ads", "1", "a", "SEARCH", 10.0, 40.0, 5.0, 100.0, 1.0) for i in range(days)]
    rows += [(d, "Meta Ads", "2", "b", "SOCIAL", 5.0, 10.0, 2.0, 50.0, 1.0) for d, *_ in rows]
    facts = spark.createDataFrame(rows, "date date, channel string, campaign_id string, campaign_name string, campaign_type string, "
                                        "spend double, revenue double, clicks double, impressions double, conversions double")
    for m in ("spend", "revenue"):
        facts = facts.withColumn(m, facts[m].cast("decimal(18,4)"))
    got = forecasting.predictions(facts).collect()
    levels = {(r.dimension_type, r.dimension_value) for r in got}
    assert len(levels) == 7 and len(got) == 7 * 3 * 2
    assert all(r.p10 <= r.p50 <= r.p90 for r in got)
    overall = [r.p50 for r in got if r.dimension_type == "Overall" and r.metric == "Revenue"]
    assert len(overall) == 3 and min(overall) > 0
