import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roaskit.operators import anchor as A
from roaskit.operators import effects as EF
from roaskit.operators import entities as E
from roaskit.operators import features as FE
from roaskit.operators import forecast as FC

D = dt.date


def days(start, n):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_rolling_features_against_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"date": days(D(2024, 1, 1), 80)})
    for m in E.MEASURES:
        pdf[m] = rng.uniform(1, 100, 80)
    cube = spark.createDataFrame(pdf).withColumn("date", F.to_date("date"))
    got = FE.daily_features(cube).orderBy("date").toPandas()
    roas = pdf.revenue / (pdf.spend + 1e-5)
    assert len(got.columns) == 45
    for w in (7, 14, 30):
        mean = pdf.revenue.shift(1).rolling(w, min_periods=1).mean().fillna(pdf.revenue.mean())
        std = pdf.revenue.shift(1).rolling(w, min_periods=1).std().fillna(0.0)
        assert np.allclose(got[f"rolling_revenue_{w}d"], mean)
        assert np.allclose(got[f"moving_std_revenue_{w}d"], std)
        assert np.allclose(got[f"variance_revenue_{w}d"], std ** 2)
        assert np.allclose(got[f"rolling_roas_{w}d"], roas.shift(1).rolling(w, min_periods=1).mean().fillna(roas.mean()))
        trend = (pdf.revenue.shift(1) - mean) / (mean + 1e-5)
        assert np.isnan(got[f"trend_revenue_{w}d"][0]) and np.allclose(got[f"trend_revenue_{w}d"][1:], trend[1:])


def test_calendar_at_year_ends(spark):
    from roaskit.functions.scalars import with_calendar
    df = spark.createDataFrame([(D(2024, 12, 30),), (D(2024, 12, 1),), (D(2024, 9, 1),)], "date date")
    got = {r.date: r for r in with_calendar(df).collect()}
    assert got[D(2024, 12, 30)].week == 1 and got[D(2024, 12, 30)].day_of_week == 0
    assert got[D(2024, 12, 1)].season == "WINTER" and got[D(2024, 12, 1)].is_weekend == 1
    assert got[D(2024, 9, 1)].season == "FALL" and got[D(2024, 9, 1)].season_encoded == 3


def test_entities_with_missing_names_are_not_the_portfolio(spark):
    facts = spark.createDataFrame(
        [(D(2024, 1, 1), None, "T", "c", 1.0, 2.0), (D(2024, 1, 1), "G", None, "c", 3.0, 4.0)],
        "date date, channel string, campaign_type string, campaign_name string, revenue double, spend double")
    got = {(r.dimension_type, r.dimension_value): r.revenue for r in E.entity_daily(facts).collect()}
    assert got == {("Overall", "Total Portfolio"): 4.0, ("Channel", "(none)"): 1.0, ("Channel", "G"): 3.0,
                   ("CampaignType", "T"): 1.0, ("CampaignType", "(none)"): 3.0, ("Campaign", "c"): 4.0}


def test_campaign_channel_ties_take_the_smaller_name(spark):
    cube = spark.createDataFrame([("c", "B", 2, 10.0), ("c", "A", 2, 30.0), ("d", "A", 1, 60.0)],
                                 "campaign_name string, channel string, fact_rows long, revenue double")
    got = {r.campaign_name: (r.channel, r.channel_share) for r in E.campaign_channels(cube).collect()}
    assert got == {"c": ("A", pytest.approx(40 / 90)), "d": ("A", pytest.approx(60 / 90))}


def holiday(start, end, factor, base=100.0):
    out, d = [], start
    while d <= end:
        out.append((d, base * (factor if d.month in (11, 12) else 1.0), 10.0))
        d += dt.timedelta(days=1)
    return out


def test_seasonal_correction_fires_after_a_holiday_peak(make_series):
    row = A.recent_anchors(make_series(holiday(D(2022, 1, 1), D(2023, 12, 31), 5.0))).first()
    assert row.revenue_deseasonalized and not row.spend_deseasonalized
    assert row.daily_revenue == pytest.approx(100.0)
    assert row.revenue_trend_per_day == pytest.approx(0.0, abs=1e-9)


def test_mild_season_leaves_the_level_alone(make_series):
    row = A.recent_anchors(make_series(holiday(D(2022, 1, 1), D(2023, 12, 31), 1.5))).first()
    assert not row.revenue_deseasonalized and row.daily_revenue == pytest.approx(150.0)


def test_a_launch_year_of_zeros_does_not_count(make_series):
    rows = [(d, 0.0, 10.0) for d in days(D(2021, 1, 1), 365)] + holiday(D(2022, 1, 1), D(2023, 12, 31), 5.0)
    got = {r.month: r.revenue_index for r in A.seasonal_index_long(make_series(rows)).collect()}
    assert got[12] == pytest.approx(5.0) and got[6] == pytest.approx(1.0)
    one_year = A.seasonal_index_long(make_series(holiday(D(2023, 1, 1), D(2023, 12, 31), 5.0)))
    assert one_year.count() == 0


@pytest.mark.parametrize("n, slope", [(59, 0.0), (60, 1.0)])
def test_momentum_needs_sixty_rows(make_series, n, slope):
    rows = [(d, 1000.0 + i, 50.0) for i, d in enumerate(days(D(2024, 1, 1), n))]
    assert A.recent_anchors(make_series(rows)).first().revenue_trend_per_day == pytest.approx(slope)


def test_momentum_is_capped_at_three_percent(make_series):
    rows = [(d, 1.0 if i < 30 else 1000.0, 50.0) for i, d in enumerate(days(D(2024, 1, 1), 60))]
    assert A.recent_anchors(make_series(rows)).first().revenue_trend_per_day == pytest.approx(30.0)


def test_effects_against_a_direct_fit(make_series):
    rng = np.random.default_rng(4)
    rows = [(d, float(rng.uniform(0, 100)), 5.0) for d in days(D(2023, 1, 1), 500)]
    pdf = pd.DataFrame(rows, columns=["date", "r", "s"])
    pdf["date"] = pd.to_datetime(pdf.date)
    fit = (pdf.groupby(pdf.date.dt.dayofweek).r.transform("mean")
           + pdf.groupby(pdf.date.dt.month).r.transform("mean") - pdf.r.mean())
    m = EF.fit_effects(make_series(rows)).first()
    assert m.revenue_std == pytest.approx(float(np.std(pdf.r - fit)), rel=1e-6)
    assert m.spend_std == pytest.approx(0.0, abs=1e-9) and m.has_model
    assert not EF.fit_effects(make_series(rows[:5])).first().has_model


def test_refresh_keeps_what_has_no_news(make_series):
    old = A.recent_anchors(make_series([(d, 10.0, 2.0) for d in days(D(2024, 1, 1), 40)], value="A")
                           .unionByName(make_series([(D(2024, 1, 1), 7.0, 2.0)], value="B")))
    new = A.recent_anchors(make_series([(d, 99.0, 2.0) for d in days(D(2024, 3, 1), 40)], value="A"))
    got = {r.dimension_value: r.daily_revenue for r in A.refresh_anchors(old, new).collect()}
    assert got == {"A": pytest.approx(99.0), "B": pytest.approx(7.0)}


def interval(spark, p50, std, n, scale):
    cols = FC.interval_columns(F.lit(p50), F.lit(std), n, scale)
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_interval_floor_and_collapse(spark):
    assert interval(spark, 100000.0, 50000.0, 30, 3.0).p10 == pytest.approx(5000.0)
    flat = interval(spark, 30000.0, 0.0, 30, 1.0)
    assert flat.p10 == flat.p50 == flat.p90 == 30000.0


def test_interval_order_holds(spark):
    rng = np.random.default_rng(42)
    rows = [(float(rng.uniform(0, 4.5e6)), float(rng.uniform(0, 20000)), h) for h in (30, 60, 90) for _ in range(50)]
    df = spark.createDataFrame(rows, "a double, s double, h int")
    for scale in (0.5, 1.0, 3.0, 10.0):
        c = FC.interval_columns(F.col("a"), F.col("s"), F.col("h"), scale)
        assert df.filter(~((c["p10"] <= c["p50"]) & (c["p50"] <= c["p90"]) & (c["p10"] >= 0))).count() == 0


def forecast_rows(spark, rows):
    return spark.createDataFrame(rows, "dimension_type string, dimension_value string, forecast_period string, "
                                 "p10 double, p50 double, p90 double, spend double")


def test_reconcile_moves_the_interval_with_the_median(spark):
    fc = forecast_rows(spark, [("Channel", "G", "30_days", 50.0, 100.0, 150.0, 10.0),
                               ("Campaign", "c", "30_days", 10.0, 20.0, 30.0, 5.0),
                               ("Campaign", "lonely", "30_days", 1.0, 2.0, 3.0, 5.0)])
    cmap = spark.createDataFrame([("c", "G", 0.6)], "campaign_name string, channel string, channel_share double")
    got = {r.dimension_value: (r.p10, r.p50, r.p90, r.spend) for r in FC.reconcile_campaigns(fc, cmap).collect()}
    assert got["c"] == (20.0, 40.0, 60.0, 5.0)
    assert got["G"][1] == 100.0 and got["lonely"] == (1.0, 2.0, 3.0, 5.0)


def test_unseen_entities_are_scaled_and_twice_as_wide(spark):
    overall = forecast_rows(spark, [("Overall", "Total Portfolio", "30_days", 80.0, 100.0, 120.0, 50.0)])
    unseen = spark.createDataFrame([("Campaign", "new"), ("CampaignType", "t")], "dimension_type string, dimension_value string")
    scales = spark.createDataFrame([("Campaign", 0.1)], "dimension_type string, scale double")
    got = {r.dimension_value: r for r in FC.unseen_forecast(unseen, overall, scales).collect()}
    new = got["new"]
    assert (new.p10, new.p50, new.p90, new.spend) == (6.0, 10.0, 14.0, 5.0)
    assert got["t"].p50 == 50.0  # the default scale of types


def test_confidence(spark):
    df = spark.createDataFrame([(90.0, 100.0, 110.0), (0.0, 100.0, 400.0), (0.0, 0.0, 1.0)], "p10 double, p50 double, p90 double")
    got = [(r.confidence_pct, r.confidence) for r in FC.with_confidence(df).orderBy(F.desc("p10"), F.desc("p50")).collect()]
    assert got == [(94, "High"), (35, "Low"), (40, "Low")]


def test_rows_of_a_series_move_once(make_series):
    series = make_series([(d, 10.0, 2.0) for d in days(D(2024, 1, 1), 40)])
    for df, most in ((EF.fit_effects(series), 1), (A.recent_anchors(series), 2)):
        moves = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())
        assert 1 <= len(moves) <= most
        assert all(re.sub(r"#\d+", "", m) == "dimension_type, dimension_value" for m in moves)


def test_maps_hold_the_keys_seen_and_the_median_of_few_months(spark, make_series):
    rows = [(D(2024, 1, 1), 6.0, 1.0), (D(2024, 1, 8), 12.0, 1.0), (D(2024, 3, 5), 3.0, 1.0)]
    m = EF.fit_effects(make_series(rows)).first()
    assert m.revenue_weekday == {0: 9.0, 1: 3.0} and m.revenue_month == {1: 9.0, 3: 3.0}
    means = spark.createDataFrame([("X", 2, 4.0, None), ("X", 5, 8.0, None), ("X", 9, None, None)],
                                  "k string, month int, revenue_mean double, spend_mean double")
    row = A.index_of_means(means, ["k"]).first()
    assert row.revenue_index == {2: 4.0 / 6.0, 5: 8.0 / 6.0} and row.spend_index is None
