"""The result documents: nested, in a fixed order, one file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.attach import attach
from roaskit.operators import backtest as B
from roaskit.operators.forecast import report_order
from roaskit.operators.insights import causal_summary
from roaskit.plans.backtesting import Backtest
from roaskit.sources import state

CHANNEL_ENTRY = ("channel", "revenue_p50", "share_pct", "roas", "interval_width_pct")
TYPE_ENTRY = ("campaign_type", "revenue_p50", "share_pct", "roas", "status", "days_since_last_spend")
ERRORS = ("revenue_wape", "revenue_rmse", "revenue_smape", "roas_rmse", "roas_smape", "interval_coverage", "rows_scored")
SEGMENT = ("metric", "forecast_period", "dimension_type", "rows", "mae", "rmse", "mape", "smape", "wape", "interval_coverage")
COMPARISON = ("metric", "forecast_period", "ensemble_mae", "ensemble_rmse", "ensemble_mape", "naive_baseline_mae",
              "naive_baseline_rmse", "naive_baseline_mape", "ensemble_beats_naive_baseline", "mape_improvement_pct")
CAMPAIGN_NOTE = ("Single campaigns vary far more than the levels above them; their errors are reported apart and not "
                 "part of the overall figures.")


def _fields(names: tuple[str, ...], **kinds: str) -> str:
    return ",".join(f"{n}:{kinds.get(n, 'double')}" for n in names)


_ERRORS = _fields(ERRORS, rows_scored="bigint")
CAUSAL_SCHEMA = (
    "generated_by string, forecast_period string, revenue_p50 double, roas_p50 double, "
    f"channel_breakdown array<struct<{_fields(CHANNEL_ENTRY, channel='string')}>>, campaign_type_breakdown array<struct<"
    f"{_fields(TYPE_ENTRY, campaign_type='string', status='string', days_since_last_spend='int')}>>, causal_summary string")
BACKTEST_SCHEMA = (
    "status string, folds bigint, origin_dates array<string>, data_quality_score double, rows_scored bigint, "
    f"overall struct<{_ERRORS}>, campaign_level struct<{_ERRORS},note:string>, by_segment array<struct<"
    f"{_fields(SEGMENT, metric='string', forecast_period='string', dimension_type='string', rows='bigint')}>>, baseline_comparison array<struct<"
    f"{_fields(COMPARISON, metric='string', forecast_period='string', ensemble_beats_naive_baseline='boolean')}>>")


def entries(rows: DataFrame, fields: tuple[str, ...], order: list[Column], name: str) -> DataFrame:
    """One row, `name`: the rows as structs of `fields`, in the order of the key columns; empty without rows."""
    keyed = rows.select(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], F.struct(*fields).alias("e")).alias("r"))
    return keyed.agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["e"]).alias(name))


def causal_document(channels: DataFrame, types: DataFrame, overall: DataFrame) -> DataFrame:
    """One row: the 90-day totals, both breakdowns by falling revenue, and the sentence made of them."""
    said = causal_summary(channels, types, overall.select("revenue_p50", "roas_p50"))
    for rows, fields, name in ((channels, CHANNEL_ENTRY, "channel_breakdown"), (types, TYPE_ENTRY, "campaign_type_breakdown")):
        said = attach(said, entries(rows, fields, [-F.col("revenue_p50"), F.col(fields[0])], name))
    return said.select(
        F.lit("rules").alias("generated_by"), F.lit("90_days").alias("forecast_period"), F.bround("revenue_p50", 2).alias("revenue_p50"),
        F.bround("roas_p50", 4).alias("roas_p50"), "channel_breakdown", "campaign_type_breakdown", "causal_summary")


def causal_rows(document: DataFrame) -> DataFrame:
    """The document's breakdowns as rows: section, place, name and the figures."""
    totals = [F.col("revenue_p50").alias("total_p50"), "roas_p50"]
    same = ["revenue_p50", "share_pct", "roas"]
    channel = document.select(*totals, F.posexplode("channel_breakdown").alias("place", "e")).select(
        F.lit("channel").alias("section"), "place", F.col("e.channel").alias("name"), *[f"e.{c}" for c in same],
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("days_since_last_spend"), "total_p50", "roas_p50")
    kind = document.select(*totals, F.posexplode("campaign_type_breakdown").alias("place", "e")).select(
        F.lit("campaign_type").alias("section"), "place", F.col("e.campaign_type").alias("name"), *[f"e.{c}" for c in same],
        "e.status", "e.days_since_last_spend", "total_p50", "roas_p50")
    return channel.unionByName(kind)


def backtest_document(done: Backtest, quality: DataFrame | None = None) -> DataFrame:
    """One row: folds, errors above and at campaigns, by segment, and beside the baseline.

    `quality` is a one-row table with quality_score; without it the score is null. A level
    without scored rows is null.
    """
    errors = B.headline_errors(done.scorecard)
    segments = B.segment_errors(done.scorecard)
    compared = B.compare_to_naive(done.scorecard, done.naive)
    row = done.scorecard.agg(F.sort_array(F.collect_set(F.date_format(B.FOLD, "yyyy-MM-dd"))).alias("origin_dates"),
                             F.count_if(F.col("dimension_type") != P.CAMPAIGN).alias("rows_scored"))
    parts = errors.agg(F.max(F.when(F.col("block") == "overall", F.struct(*ERRORS))).alias("overall"),
                       F.max(F.when(F.col("block") == "campaign_level", F.struct(*ERRORS, F.lit(CAMPAIGN_NOTE).alias("note")))).alias("campaign_level"))
    row = attach(row, parts)
    row = attach(row, entries(segments, SEGMENT, [F.col(c) for c in SEGMENT[:3]], "by_segment"))
    row = attach(row, entries(compared, COMPARISON, [F.col(c) for c in COMPARISON[:2]], "baseline_comparison"))
    row = row.withColumn("quality_score", F.lit(None).cast("double")) if quality is None else attach(row, quality, "quality_score")
    return row.select(
        F.when(F.size("origin_dates") > 0, "ok").otherwise("empty").alias("status"), F.size("origin_dates").cast("long").alias("folds"),
        "origin_dates", F.col("quality_score").cast("double").alias("data_quality_score"), "rows_scored", "overall", "campaign_level",
        "by_segment", "baseline_comparison")


def backtest_rows(document: DataFrame) -> DataFrame:
    """The document's segments and comparisons as rows."""
    totals = ["folds", "rows_scored"]
    segment = document.select(*totals, F.posexplode("by_segment").alias("place", "e")).select(
        F.lit("segment").alias("section"), "place", "e.metric", "e.forecast_period", "e.dimension_type", "e.mae", "e.mape", *totals)
    baseline = document.select(*totals, F.posexplode("baseline_comparison").alias("place", "e")).select(
        F.lit("baseline").alias("section"), "place", "e.metric", "e.forecast_period", F.lit(P.OVERALL).alias("dimension_type"),
        F.col("e.ensemble_mae").alias("mae"), F.col("e.ensemble_mape").alias("mape"), *totals)
    return segment.unionByName(baseline)


def write_report(predictions: DataFrame, path: str) -> None:
    """The predictions as CSV in the order of a report: level, entity, period, Revenue first."""
    state.write_predictions(report_order(predictions), path)
