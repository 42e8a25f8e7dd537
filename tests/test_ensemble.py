import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.operators import anchor as A
from roaskit.operators import boosting as BO
from roaskit.operators import ensemble as EN
from roaskit.operators import entities as E
from roaskit.operators import forecast as FC
from roaskit.operators import leastsquares as LS
from roaskit.plans import forecasting
from roaskit.plans.backtesting import run_backtest

EVERY = tuple(P.ENSEMBLE_WEIGHTS)


def design(days, first, last):
    rows = []
    for d in days:
        row = [1.0, (d - last).days / 365.25] + [float(d.weekday() == k) for k in range(1, 7)]
        for k in range(1, 11):
            a = 2 * math.pi * k * (d - first).days / 365.25
            row += [math.cos(a), math.sin(a)] if (last - first).days >= 365 else [0.0, 0.0]
        rows.append(row)
    return np.array(rows)


def test_seasonal_member_equals_a_direct_fit_of_each_series(spark):
    rng = np.random.default_rng(3)
    lengths = {"long": 800, "year": 366, "short": 365, "week": 5, "one": 1}
    series, rows = {}, []
    for name, n in lengths.items():
        days = [dt.date(2021, 3, 1) + dt.timedelta(days=i) for i in range(n) if i % 11 != 4 or n < 9]
        y = np.array([1000 + 2 * i + 90 * d.weekday() + 50 * math.sin(i / 58) + rng.normal(0, 5) for i, d in enumerate(days)])
        series[name] = (days, y)
        rows += [("Overall", name, d, float(v), float(v) / 4) for d, v in zip(days, y)]
    df = spark.createDataFrame(rows, "dimension_type string, dimension_value string, date date, revenue double, spend double")
    fit = LS.fit_seasonal(df)
    got = {r.dimension_value: r for r in fit.collect()}
    assert set(got) == set(lengths)
    for name, (days, y) in series.items():
        x = design(days, days[0], days[-1])
        ahead = [days[-1] + dt.timedelta(days=i) for i in range(1, 20)]
        beta = np.linalg.solve(x.T @ x + P.RIDGE * np.eye(28), x.T @ y)
        r = got[name]
        assert np.allclose(np.array(r.revenue_beta), beta, rtol=1e-5, atol=1e-3) and np.allclose(np.array(r.spend_beta), beta / 4, rtol=1e-5, atol=1e-3)
        assert r.revenue_std == pytest.approx(float(np.std(y - x @ beta)), abs=1e-4)
        if len(days) > 300:
            want = x @ np.linalg.lstsq(x, y, rcond=None)[0]
            assert np.allclose(x @ np.array(r.revenue_beta), want, rtol=1e-6)
            future = spark.createDataFrame([("Overall", name, d) for d in ahead], "dimension_type string, dimension_value string, date date")
            val = [v.v for v in future.join(fit, E.ENTITY).select("date", LS.seasonal_value("revenue").alias("v")).orderBy("date").collect()]
            assert np.allclose(val, design(ahead, days[0], days[-1]) @ beta, rtol=1e-7)


def exact_tree(x, y, depth, penalty, least):
    """Greedy splits over all thresholds between values; nested pairs, leaves are values."""
    def leaf(i):
        return y[i].sum() / (len(i) + penalty)

    def score(i):
        return y[i].sum() ** 2 / (len(i) + penalty) if len(i) + penalty > 0 else 0.0

    def build(i, level):
        if level == depth:
            return leaf(i)
        best = (1e-9 * max(1.0, float((y ** 2).sum())), None)
        for f in range(x.shape[1]):
            values = np.unique(x[i, f])
            for a, b in zip(values, values[1:]):
                left, right = i[x[i, f] <= a], i[x[i, f] > a]
                if min(len(left), len(right)) >= least:
                    gain = score(left) + score(right) - score(i)
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, (f, a, left, right))
        if best[1] is None:
            return leaf(i)
        f, _, left, right = best[1]
        return [left, right, build(left, level + 1), build(right, level + 1)]

    out = np.zeros(len(y))

    def fill(node, i):
        if isinstance(node, list):
            fill(node[2], node[0])
            fill(node[3], node[1])
        else:
            out[i] = node
    fill(build(np.arange(len(y)), 0), np.arange(len(y)))
    return out


@pytest.mark.parametrize("penalty, least", [(1.0, 1), (0.0, 7), (3.0, 2)])
def test_trees_equal_exact_greedy_trees(penalty, least):
    rng = np.random.default_rng(int(penalty) + least)
    x = np.stack([rng.integers(0, 40, 120), rng.integers(0, 7, 120), rng.normal(size=120).round(1)], axis=1).astype(float)
    y = rng.normal(size=120) + x[:, 0] / 9 + (x[:, 1] > 3)
    how = BO.Learner(rounds=6, depth=3, step=0.3, penalty=penalty, least_rows=least)
    got = BO.boosted(x, y, how)
    fitted = np.full(120, y.mean())
    for _ in range(6):
        fitted += 0.3 * exact_tree(x, y - fitted, 3, penalty, least)
    assert np.allclose(BO.predicted(x, got["base"], got["feature"], got["threshold"], got["value"], 3), fitted)


def test_level_split_uses_one_split_a_level_and_a_constant_column_none():
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(size=(200, 2)), np.ones(200)]
    y = np.sign(x[:, 0]) * np.sign(x[:, 1])
    got = BO.boosted(x, y, BO.Learner(rounds=40, depth=2, step=0.5, level_split=True))
    per_tree = got["feature"].reshape(-1, 3)
    assert (per_tree[:, 1] == per_tree[:, 2]).all() and set(per_tree.ravel()) <= {0, 1}
    flat = BO.boosted(np.ones((9, 2)), np.arange(9.0), BO.Learner(rounds=2, depth=2))
    assert np.isinf(flat["threshold"]).all() and np.allclose(BO.predicted(np.ones((1, 2)), flat["base"], flat["feature"], flat["threshold"], flat["value"], 2), 4.0)
    many = BO.bin_edges(np.arange(1000.0))
    assert len(many) < BO.BINS and (np.diff(many) > 0).all()


@pytest.fixture(scope="module")
def cube(channels_400d):
    return channels_400d.withColumn("conversions", F.lit(1.0)).withColumn("campaign_type", F.lit("t")).withColumn(
        "campaign_name", F.col("channel")).withColumn("fact_rows", F.lit(1))


def test_ensemble_is_the_weighted_sum_of_its_members(spark, cube):
    totals = EN.portfolio_days(cube).cache()
    series = totals.select(*E.ENTITY, "date", "revenue", "spend")
    model = forecasting.fit_portfolio(series, E.ENTITY, EVERY, totals)
    assert model.trees.count() == 4 and model.newest.count() == 1
    features = EN.feature_days(totals, E.ENTITY)
    fit = EN.member_values(model, features, E.ENTITY, EVERY).cache()
    assert fit.count() == 400
    gap = F.max(F.abs(F.col("raw") - (0.35 * F.col("m_seasonal") + 0.25 * F.col("m_tree_a") + 0.2 * F.col("m_tree_b") + 0.2 * F.col("m_tree_c"))))
    assert fit.select(gap).first()[0] < 1e-6
    spread = fit.select(F.stddev_pop(F.col("revenue") - F.col("raw")).alias("s"), F.stddev_pop("revenue").alias("all")).first()
    assert model.spread.first().revenue_std == pytest.approx(spread.s) and spread.s < 0.2 * spread["all"]
    daily = EN.portfolio_daily(model, A.recent_anchors(series), F.lit("2024-04-10").cast("date")).cache()
    rows = FC.horizon_intervals(daily).collect()
    assert len(rows) == 3 and all(0 <= r.p10 <= r.p50 <= r.p90 for r in rows)
    traj = FC.daily_trajectory(daily, F.col("std_daily")).orderBy("day").collect()
    assert len(traj) == 90 and traj[89].p90 - traj[89].p50 > traj[0].p90 - traj[0].p50
    assert EN.weights_of(("seasonal",)) == {"seasonal": 1.0} and EN.weights_of(EVERY) == pytest.approx(P.ENSEMBLE_WEIGHTS)


def test_overall_rows_of_both_tables_come_from_the_members(spark, cube):
    facts = cube.drop("fact_rows")
    for members in (EVERY,):
        table = {(r.forecast_period, r.metric): r.p50 for r in forecasting.predictions(facts, members).collect() if r.dimension_type == "Overall"}
        own = {r.forecast_period: r for r in forecasting.overall_forecast(facts, members)[0].collect()}
        for period, r in own.items():
            assert table[period, "Revenue"] == pytest.approx(r.p50, abs=0.02) and table[period, "ROAS"] == pytest.approx(r.p50 / r.spend, abs=0.02)


def test_every_fold_of_a_backtest_has_its_own_members(spark, cube):
    facts = cube.drop("fact_rows")
    got = run_backtest(facts, folds=2, members=EVERY).scorecard.filter("dimension_type = 'Overall' and metric = 'Revenue'").collect()
    assert len(got) == 6 and len({r.origin_date for r in got}) == 2
    first = min(r.origin_date for r in got)
    alone = {x.forecast_period: x.p50 for x in forecasting.overall_forecast(facts.filter(F.col("date") < F.lit(first)), EVERY)[0].collect()}
    assert {r.forecast_period: r.p50 for r in got if r.origin_date == first} == pytest.approx(alone, abs=0.02)
