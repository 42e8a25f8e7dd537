"""The backtest as one plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.operators import backtest, entities, forecast
from roaskit.operators.backtest import FOLD
from roaskit.operators.ensemble import portfolio_days
from roaskit.plans.forecasting import MEMBERS, forecast_levels, prepare
from roaskit.sources.storage import materialize


class Backtest(NamedTuple):
    scorecard: DataFrame
    naive: DataFrame
    origins: DataFrame


def run_backtest(facts: DataFrame, folds: int = 3, min_train: int = P.MIN_TRAIN_DAYS,
                 horizon: int = P.MAX_HORIZON, keep: bool = True, members: tuple[str, ...] = MEMBERS) -> Backtest:
    """Every fold trained, forecast and scored in one job: a fold is a column.

    The scorecard is written to the shared folder when `keep`, as summaries read
    it several times.
    """
    cube, series = prepare(facts)
    origins = materialize(backtest.make_origins(series, folds, horizon, min_train), "origins")
    train = materialize(backtest.training_folds(series, origins), "folds")
    trained = train.select(FOLD).distinct()
    by_fold = materialize(backtest.fold_sums(
        cube, origins, ["campaign_name", "channel"], ["fact_rows", "revenue"])
        .join(trained, FOLD, "left_semi"), "foldmap")
    days = None
    if set(members) - set(P.LINEAR_MEMBERS):
        days = backtest.training_folds(portfolio_days(cube), origins).join(trained, FOLD, "left_semi")
    fc = forecast_levels(train, entities.campaign_channels(by_fold, [FOLD]), F.col(FOLD), [FOLD], members, days)
    revenue = by_fold.groupBy(FOLD, "campaign_name").agg(
        F.sum("revenue").cast("double").alias("revenue"))
    preds = forecast.predictions_long(fc, forecast.top_per_fold(revenue, FOLD), [FOLD])
    act = backtest.actuals(series, origins)
    scorecard = backtest.score_forecasts(preds, act)
    overall = series.filter(F.col("dimension_type") == P.OVERALL)
    naive = backtest.score_naive(backtest.naive_baseline(overall, origins), act).join(
        trained, FOLD, "left_semi")
    if keep:
        scorecard, naive = materialize(scorecard, "scorecard"), materialize(naive, "naive")
    return Backtest(scorecard, naive, origins)
