from datetime import date, timedelta

import numpy as np
import pytest

from roaskit.operators import drivers as DR
from roaskit.plans import documents as DOC
from roaskit.plans.backtesting import Backtest
from roaskit.sources import state

CHANNELS = "channel string, revenue_p50 double, share_pct double, roas double, interval_width_pct double"
TYPES = "campaign_type string, revenue_p50 double, share_pct double, roas double, status string, days_since_last_spend int"


def causal(spark):
    channels = spark.createDataFrame([("Low", 10.0, 4.0, 2.0, 9.0), ("Tie B", 120.0, 48.0, 3.0, 8.0), ("Tie A", 120.0, 48.0, 3.5, 20.0)], CHANNELS)
    types = spark.createDataFrame([("Never", 0.0, 0.0, 0.0, "no_spend_on_record", None), ("Search", 250.0, 100.0, 3.1, "active", 2)], TYPES)
    return DOC.causal_document(channels, types, spark.createDataFrame([(250.0, 3.2)], "revenue_p50 double, roas_p50 double"))


def test_causal_document_goes_out_and_back(spark, tmp_path):
    doc, path = causal(spark), f"{tmp_path}/causal.json"
    state.write_document(doc, path)
    state.write_document(doc, path)  # over the one before
    back = state.read_document(spark, path, DOC.CAUSAL_SCHEMA)
    assert back.collect() == doc.collect() and back.columns == doc.columns
    row = back.first()
    assert [c.channel for c in row.channel_breakdown] == ["Tie A", "Tie B", "Low"]  # equal revenue by name
    assert [(t.campaign_type, t.days_since_last_spend) for t in row.campaign_type_breakdown] == [("Search", 2), ("Never", None)]
    with open(path) as f:
        text = f.read()
    assert text.index("generated_by") < text.index("channel_breakdown") < text.index("campaign_type_breakdown") < text.index("causal_summary")
    assert '"days_since_last_spend" : null' in text


def test_documents_that_are_absent_or_damaged(spark, tmp_path):
    with pytest.raises(state.StateError):
        state.read_document(spark, f"{tmp_path}/none.json", DOC.CAUSAL_SCHEMA)
    (tmp_path / "bad.json").write_text('{"generated_by": "rules", "channel_breakdown": [')
    with pytest.raises(state.StateError):
        state.read_document(spark, f"{tmp_path}/bad.json", DOC.CAUSAL_SCHEMA)
    with pytest.raises(state.StateError):
        state.write_document(spark.range(2), f"{tmp_path}/two.json")


SCORE = state.SCORECARD_SCHEMA


def test_backtest_document(spark, tmp_path):
    rows = [(date(2024, 1, d), level, name, "30_days", metric, 100.0, 80.0, 90.0, 120.0, 10.0, 10.0, 10.5, True)
            for d in (1, 2) for level, name in (("Overall", "All"), ("Campaign", "c")) for metric in ("Revenue", "ROAS")]
    score = spark.createDataFrame(rows, SCORE)
    naive = score.filter("dimension_type = 'Overall'").withColumn("ape", score.ape * 2)
    doc = DOC.backtest_document(Backtest(score, naive, None), spark.createDataFrame([(88.5,)], "quality_score double"))
    path = f"{tmp_path}/backtest.json"
    state.write_document(doc, path)
    row = state.read_document(spark, path, DOC.BACKTEST_SCHEMA).first()
    assert (row.status, row.folds, row.origin_dates, row.data_quality_score, row.rows_scored) == ("ok", 2, ["2024-01-01", "2024-01-02"], 88.5, 4)
    assert row.overall.revenue_wape == 10.0 and row.campaign_level.rows_scored == 4 and "Single campaigns" in row.campaign_level.note
    assert [(s.metric, s.dimension_type) for s in row.by_segment] == [("ROAS", "Campaign"), ("ROAS", "Overall"), ("Revenue", "Campaign"), ("Revenue", "Overall")]
    assert [(c.ensemble_mape, c.naive_baseline_mape, c.mape_improvement_pct) for c in row.baseline_comparison] == [(10.0, 20.0, 50.0)] * 2
    none = DOC.backtest_document(Backtest(score.limit(0), naive.limit(0), None)).first()
    assert (none.status, none.folds, none.by_segment, none.overall, none.data_quality_score) == ("empty", 0, [], None, None)


def test_report_is_written_in_order(spark, tmp_path):
    rows = [(p, t, v, m, 1.0, 2.0, 3.0) for m in ("ROAS", "Revenue") for p in ("60_days", "30_days")
            for t, v in (("Campaign", "c"), ("Channel", "b"), ("Overall", "All"), ("Channel", "a"))]
    DOC.write_report(spark.createDataFrame(rows, state.PREDICTION_SCHEMA).repartition(5), f"{tmp_path}/report")
    lines = [x for f in sorted((tmp_path / "report").glob("part-*")) for x in f.read_text().splitlines()[1:]]
    got = [tuple(x.split(",")[:4]) for x in lines]
    level = ["Overall", "Channel", "CampaignType", "Campaign"]
    assert got == sorted([r[:4] for r in rows], key=lambda r: (level.index(r[1]), r[2], r[0], r[3] != "Revenue"))


@pytest.mark.parametrize("target", ["revenue", "roas"])
def test_linear_importance_equals_least_squares(spark, target):
    draw = np.random.default_rng(5)
    days = [(date(2024, 1, 1) + timedelta(days=i), c, float(s), float(s * 2 + k + 50 * draw.random()), int(k), int(v))
            for i in range(300) for c in "abc" for s, k, v in [draw.integers((100, 10, 2000), (900, 90, 9000))]]
    m = DR.driver_matrix(spark.createDataFrame(days, "date date, channel string, spend double, revenue double, clicks long, impressions long"))
    rows = m.toPandas()
    y = rows["roas"].clip(upper=20.0) if target == "roas" else rows["revenue"]
    x = rows[list(DR.DRIVERS)].astype(float).to_numpy()
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y.to_numpy(), rcond=None)[0][1:]
    want = dict(zip(DR.DRIVERS, np.abs(beta * (x - x.mean(axis=0))).mean(axis=0)))
    got = {r.feature: r.impact for r in DR.linear_importance(m, target).collect()}
    top = max(want.values())
    assert all(got[d] == pytest.approx(want[d], rel=1e-4, abs=1e-6 * top) for d in DR.DRIVERS)


def test_linear_importance_of_a_driver_that_does_not_vary(spark):
    days = [(date(2024, 1, 1) + timedelta(days=i), "a", 10.0 + i % 5, 3.0 * (10 + i % 5), 7, 70) for i in range(28)]
    facts = spark.createDataFrame(days, "date date, channel string, spend double, revenue double, clicks long, impressions long")
    got = {r.feature: r.impact for r in DR.linear_importance(DR.driver_matrix(facts)).collect()}
    assert got["clicks"] == got["channel_encoded"] == got["month"] == 0.0 and got["spend"] + got["cpc"] > 3.0
