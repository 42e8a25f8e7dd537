import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from roaskit.operators import budget as BU
from roaskit.operators import drivers as DR
from roaskit.operators import insights as IN
from roaskit.operators import risk as R
from roaskit.operators import scenarios as SC
from roaskit.operators.quantiles import quantile_cases

FACT = "date date, channel string, spend double, revenue double"


def test_curves_are_in_range_and_rise(spark, channels_400d):
    curves = BU.fit_response_curves(channels_400d)
    for r in curves.collect():
        assert r.alpha > 0 and 0 < r.beta <= 1 and 0 <= r.fit_cv <= 0.6
    base = spark.createDataFrame([(c, 10000.0) for c in ("Google Ads", "Meta Ads", "Bing Ads", "New")], "channel string, spend double")
    flat = {r.channel: r for r in BU.simulate_budget(base, curves, {}).collect()}
    up = {r.channel: r for r in BU.simulate_budget(base, curves, {"Google Ads": 20.0}).collect()}
    assert up[None].revenue > flat[None].revenue > 0
    assert up["Google Ads"].revenue_change_pct > 0 and up["Meta Ads"].revenue_change_pct == 0
    assert flat["New"].revenue == pytest.approx(25 * 10000 ** 0.82)


def test_ramp_up_months_do_not_count(spark):
    """Two months that spend without revenue stay out: the curve goes through the one spend level of the others."""
    months = [(2022, 11, 700.0, 0.0), (2022, 12, 950.0, 0.0), *((2023, m, 5000.0, 12.5 * 5000.0 ** 0.78) for m in range(1, 7))]
    rows = [(dt.date(y, m, d), "Bing Ads", spend / 10, revenue / 10) for y, m, spend, revenue in months for d in range(5, 15)]
    curve = BU.fit_response_curves(spark.createDataFrame(rows, FACT)).first()
    assert curve.alpha == pytest.approx(12.5, rel=1e-9) and curve.fit_cv == pytest.approx(0.0, abs=1e-6)


def curve_table(spark, rows):
    return spark.createDataFrame([(c, a, b, 4.0, 0.1) for c, a, b in rows],
                                 "channel string, alpha double, beta double, base_roas double, fit_cv double")


@pytest.mark.parametrize("target", [0.5, 4.0, 5.5, 7.0])
def test_allocation_is_the_best_on_its_grid(spark, target):
    budget, steps = 1000.0, 20
    rows = [("a", 20.0, 0.8), ("b", 12.0, 0.85), ("c", 2.0, 0.78)]
    curves = curve_table(spark, rows)
    got = BU.allocate_budget(curves, budget, target, steps)
    bounds = {r.channel: (r.lower, r.upper) for r in BU.allocation_bounds(curves, budget).collect()}
    grids = []
    for c, _, _ in rows:
        lo, hi = bounds[c]
        grid = [lo + i * budget / steps for i in range(int((hi - lo) / (budget / steps) + 1e-9) + 1)]
        grids.append(grid if hi - grid[-1] < 1e-6 else [*grid, hi])
    best, best_roas = None, 0.0
    for combo in itertools.product(*grids):
        if sum(combo) > budget * (1 + 1e-9):
            continue
        rev = sum(a * s ** b for s, (_, a, b) in zip(combo, rows))
        best_roas = max(best_roas, rev / sum(combo))
        if rev / (sum(combo) + 1e-5) >= target and (best is None or rev > best):
            best = rev
    total = BU.allocation_total(got, budget, target).first()
    assert total.recommended_total_spend <= budget * 1.000001
    if best is None:
        assert total.expected_total_roas == pytest.approx(best_roas, rel=1e-6)
        assert not total.target_achievable and "out of reach" in total.target_achievement_note
    else:
        assert total.expected_total_revenue == pytest.approx(best, rel=1e-9)
        assert total.target_achievable and total.target_achievement_note is None
    assert total.revenue_p10 <= total.revenue_p50 <= total.revenue_p90
    assert sum(r.budget_share for r in got.collect()) == pytest.approx(100.0)


def test_allocation_rejects_a_bad_budget(spark):
    with pytest.raises(ValueError):
        BU.allocation_bounds(curve_table(spark, [("a", 1.0, 0.8)]), -1.0)


def test_allocation_report_has_a_total(spark):
    got = BU.allocation_report(BU.allocate_budget(curve_table(spark, [("a", 20.0, 0.8), ("b", 12.0, 0.85)]), 100.0, 1.0, 10))
    total = [r for r in got.collect() if r.channel is None][0]
    assert total.budget_share == pytest.approx(100.0)


def test_volatility_bounds(spark):
    v = lambda s, b: spark.range(1).select(SC.revenue_volatility(F.lit(s).cast("double"), F.lit(b).cast("double"))).first()[0]
    assert 0.03 <= v(5000.0, 100000.0) <= 0.60
    assert v(None, 100000.0) == 0.15 and v(1.0, 0.0) == 0.15 and v(0.0, 10.0) == 0.03


def test_cases_are_exact_quantiles(spark):
    rows = spark.createDataFrame([(c, float(v)) for c in "ab" for v in range(101)], "channel string, v double")
    for r in quantile_cases(rows, "v", ["channel"]).collect():
        assert (r.worst_case, r.expected_case, r.best_case) == (10.0, 50.0, 90.0)


def greedy(rows, budget, steps, lower, target):
    """Allocation by taking the best increment again and again, one at a time."""
    total = sum(a * (budget / len(rows)) ** b for _, a, b in rows)
    bounds = {}
    for c, a, b in rows:
        share = a * (budget / len(rows)) ** b / total
        tight = min(max(share * budget * 2.5, budget * 0.02), budget * 0.15)
        bounds[c] = (budget * lower, max(budget * lower, tight if share < 0.1 else budget * 0.85))
    inc, cells = budget / steps, []
    for c, a, b in rows:
        lo, hi = bounds[c]
        at, k = lo, 1
        while at < hi - 1e-9 * inc:
            to = min(lo + k * inc, hi)
            cells.append((-round((a * to ** b - a * at ** b) / (to - at), 9), c, k, to - at, a * to ** b - a * at ** b))
            at, k = to, k + 1
    cells.sort()
    spend, revenue = sum(lo for lo, _ in bounds.values()), sum(a * bounds[c][0] ** b for c, a, b in rows)
    best, seen = None, (0.0, 0)
    for i, (_, _, _, s, r) in enumerate([(0, 0, 0, 0.0, 0.0), *cells]):
        spend, revenue = spend + s, revenue + r
        if spend <= budget * (1 + 1e-9):
            if revenue / (spend + 1e-5) >= target:
                best = i
            seen = max(seen, (revenue / (spend + 1e-5), i))
    out = {c: lo for c, (lo, _) in bounds.items()}
    for _, c, _, s, _ in cells[:seen[1] if best is None else best]:
        out[c] += s
    return out


@pytest.mark.parametrize("n, target", [(5, 1.0), (60, 2.0), (120, 1.5), (500, 2.0)])
def test_allocation_of_any_number_of_channels(spark, n, target):
    rows = [(f"c{i:03d}", 3.0 + (i * 37 % 101) / 10, 0.70 + (i * 13 % 17) / 100) for i in range(n)]
    lower = 0.1 / n
    got = {r.channel: r.allocated_spend for r in BU.allocate_budget(curve_table(spark, rows), 100_000.0, target, 200, lower).collect()}
    want = greedy(rows, 100_000.0, 200, lower, target)
    assert len(got) == n and len({round(v, 3) for v in got.values()}) > 2
    assert all(got[c] == pytest.approx(want[c], rel=1e-9) for c in want)


def test_lower_bounds_that_take_the_budget_are_refused(spark):
    with pytest.raises(ValueError, match="lower_share"):
        BU.allocation_bounds(curve_table(spark, [(f"c{i}", 2.0, 0.8) for i in range(100)]), 1000.0)


def test_risk_score_and_class(channels_400d):
    r = R.risk_profile(R.weekly_channel(channels_400d), 95.0).first()
    assert 0 <= r.risk_score <= 100
    assert r.risk_classification == ("Low Risk" if r.risk_score < 35 else "Medium Risk" if r.risk_score < 65 else "High Risk")
    assert R.risk_factors(R.risk_profile(R.weekly_channel(channels_400d), 95.0)).count() == 4


def test_a_dominant_channel_is_flagged(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), c, s, r) for i in range(200)
            for c, s, r in (("Google Ads", 1000.0, 4000.0), ("Bing Ads", 10.0, 25.0))]
    f = {r.name: r for r in R.risk_factors(R.risk_profile(R.weekly_channel(spark.createDataFrame(rows, FACT)), 95.0)).collect()}
    assert f["Channel Dependency"].status == "Concentrated" and "Google Ads" in f["Channel Dependency"].mitigation


def test_seven_scenarios(spark):
    base = spark.createDataFrame([(f"{30 * i}_days", 1e5 * i, 4.0, 25e3 * i) for i in (1, 2, 3)],
                                 "forecast_period string, revenue double, roas double, spend double")
    rows = SC.scenario_forecasts(base, F.lit(0.15)).collect()
    assert len(rows) == 21 and len({r.id for r in rows}) == 7
    for r in rows:
        assert 0 < r.Revenue_P10 <= r.Revenue_P50 <= r.Revenue_P90 and r.ROAS_P10 <= r.ROAS_P50 <= r.ROAS_P90
    expected = [r for r in rows if r.id == "expected" and r.forecast_period == "30_days"][0]
    assert expected.Revenue_P50 == 1e5 and expected.Spend_Expected == 25e3
    none = base.select("forecast_period", *[F.lit(None).cast("double").alias(c) for c in ("revenue", "roas", "spend")])
    assert {r.Revenue_P50 for r in SC.scenario_forecasts(none, F.lit(0.15)).collect() if r.id == "expected"} == {250000.0}


def test_insights_name_only_present_channels(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "Bing Ads", 200.0, 500.0, 1000.0) for i in range(150)]
    cube = spark.createDataFrame(rows, FACT + ", impressions double")
    periods = IN.channel_periods(cube)
    text = " ".join(r.title + r.insight for r in IN.growth_opportunities(periods).collect())
    assert "Bing Ads" in text and "Meta" not in text and "Google" not in text
    eff = IN.channel_efficiency(cube)
    a = IN.anchor_and_momentum(eff, periods).first()
    assert a.efficiency_anchor == a.momentum_driver == "Bing Ads"
    pop = IN.period_over_period(periods).first()
    assert pop.revenue_recent == 31 * 500 and pop.revenue_prior == 30 * 500


def test_insight_tables(channels_400d):
    periods, eff = IN.channel_periods(channels_400d), IN.channel_efficiency(channels_400d)
    recs = IN.budget_recommendations(eff).collect()
    assert [r.channel for r in recs] == ["Google Ads", "Meta Ads", "Bing Ads"]
    assert recs[-1].action.startswith("Re-allocate (-") and 5 <= recs[-1].magnitude <= 30
    titles = {r.channel: r.title for r in IN.growth_opportunities(periods).collect()}
    assert titles["Google Ads"] == "Google Search High-Intent Pacing" and titles["Meta Ads"].startswith("Meta")
    roles = [r.role for r in IN.channel_trends(periods).collect()]
    assert sorted(roles) == ["declining", "other", "stable"]
    risk = R.risk_profile(R.weekly_channel(channels_400d), 95.0)
    assert IN.risk_assessment(IN.period_over_period(periods), risk).count() == 2
    note = IN.budget_shift_note(eff).first()
    assert (note.best_channel, note.worst_channel) == ("Google Ads", "Bing Ads") and note.roas_gain > 0


def test_driver_importance(spark, channels_400d):
    m = DR.driver_matrix(channels_400d).cache()
    top = DR.linear_importance(m).collect()
    assert len(top) == 8 and top[0].feature == "spend"
    trees = DR.tree_importance(m, trees=3, depth=3).collect()
    assert sum(r.impact for r in trees) == pytest.approx(1.0) and trees[0].feature == "spend"
    model = DR.fit_tree_model(m, trees=3, depth=3)
    perm = {r.feature: r.impact for r in DR.permutation_importance(m, model).collect()}
    assert len(perm) == 8 and max(perm, key=perm.get) == "spend"
    assert [r.channel for r in DR.channel_importance(channels_400d).orderBy(F.desc("importance_score")).collect()][0] == "Google Ads"


def test_kpi_overview_reads_the_facts_once(spark, monkeypatch):
    from roaskit.plans import queries_business as Q
    from roaskit.plans.catalog import REGISTRY
    reads, facts = [], Q.campaign_facts
    monkeypatch.setattr(Q, "campaign_facts", lambda *a: (reads.append(a), facts(*a))[1])
    row = REGISTRY["kpi_overview"].build(spark, "/root/testdata/sf0.001").first()
    total = facts(spark, "/root/testdata/sf0.001").agg(F.sum("spend").cast("double").alias("s"), F.sum("revenue").cast("double").alias("r")).first()
    assert len(reads) == 1 and row.total_spend == pytest.approx(total.s) and row.total_revenue == pytest.approx(total.r)
