import datetime as dt

import pytest
from pyspark.sql import functions as F

from roaskit.operators import backtest as B
from roaskit.operators.entities import ENTITY

ORIGIN = dt.date(2026, 4, 1)


def origins(spark):
    return spark.createDataFrame([([ORIGIN],)], "origins array<date>")


def run(days, revenue, spend):
    return [(ORIGIN - dt.timedelta(days=d), revenue, spend) for d in days]


def naive(spark, series):
    rows = B.naive_forecast(B.naive_baseline(series, origins(spark))).collect()
    return {(r.forecast_period, r.metric): r.predicted for r in rows}


def test_naive_is_a_flat_mean(spark, make_series):
    got = naive(spark, make_series(run(range(1, 31), 1000, 200), "Overall"))
    assert got[("30_days", "Revenue")] == pytest.approx(30000.0)
    assert got[("90_days", "Revenue")] == pytest.approx(90000.0)
    assert got[("30_days", "ROAS")] == pytest.approx(5.0)


def test_naive_looks_back_thirty_calendar_days(spark, make_series):
    rows = run(range(31, 41), 1_000_000, 1) + run(range(1, 31), 500, 100)
    assert naive(spark, make_series(rows))[("30_days", "Revenue")] == pytest.approx(15000.0)


def test_naive_without_recent_history_is_absent(spark, make_series):
    assert naive(spark, make_series([(dt.date(2020, 1, d), 100, 10) for d in range(1, 6)])) == {}


@pytest.mark.parametrize("n, folds, want", [
    (400, 1, [310]), (400, 3, [120, 215, 310]), (400, 4, [120, 183, 246, 310]), (210, 4, [120]),
    (209, 3, [])])
def test_origins(spark, make_series, n, folds, want):
    start = dt.date(2024, 1, 1)
    s = make_series([(start + dt.timedelta(days=i), 1, 1) for i in range(n)])
    assert [(d - start).days for d in B.make_origins(s, folds).first().origins] == want


def test_scores_of_a_known_prediction(spark, make_series):
    series = make_series([(ORIGIN + dt.timedelta(days=i), 10, 5) for i in range(45)])
    act = B.actuals(series, origins(spark))
    got = {r.forecast_period: (r.revenue, r.roas) for r in act.collect()}
    assert got == {"30_days": (300.0, 2.0), "60_days": (450.0, 2.0), "90_days": (450.0, 2.0)}
    preds = spark.createDataFrame(
        [(ORIGIN, "30_days", "Channel", "X", "Revenue", 200.0, 330.0, 400.0),
         (ORIGIN, "30_days", "Channel", "gone", "Revenue", 1.0, 1.0, 1.0)],
        "origin_date date, forecast_period string, dimension_type string, dimension_value string, metric string, "
        "p10 double, p50 double, p90 double")
    row = B.score_forecasts(preds, act).collect()
    assert len(row) == 1
    assert (row[0].absolute_error, row[0].ape, row[0].covered_by_interval) == (30.0, 10.0, True)
    assert row[0].smape == pytest.approx(200 * 30 / 630, abs=1e-4)


def test_short_folds_are_left_out(spark, make_series):
    series = make_series(run(range(1, 14), 1, 1))
    assert B.training_folds(series, origins(spark)).count() == 0
    series = make_series(run(range(1, 15), 1, 1))
    assert B.training_folds(series, origins(spark)).select(*ENTITY, B.FOLD).count() == 14


def test_best_per_group(spark):
    seg = spark.createDataFrame(
        [("Revenue", p, t, float(w), 50.0) for t, off in (("Overall", 0), ("Channel", 5))
         for p, w in (("30_days", 3 + off), ("60_days", 1 + off))],
        "metric string, forecast_period string, dimension_type string, wape double, smape double")
    got = [(r.dimension_type, r.forecast_period) for r in B.best_per_group(seg).collect()]
    assert got == [("Overall", "60_days"), ("Channel", "60_days")]
    assert B.ranked_segments(seg, 1, worst=True).first().wape == 8.0
