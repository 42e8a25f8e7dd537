"""The forecast as one plan, from facts to the predictions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.attach import scalar_of
from roaskit.operators import effects, ensemble, entities, forecast
from roaskit.operators.anchor import recent_anchors
from roaskit.operators.entities import ENTITY
from roaskit.sources.state import PARAM_DEFAULTS
from roaskit.sources.storage import materialize

#: The portfolio's members where none are named: what SQL can check.
MEMBERS = P.LINEAR_MEMBERS
DAILY_COLUMNS = ("day", "date", "revenue", "spend", "std_daily", "has_model", "total_revenue")


def fit_portfolio(series: DataFrame, keys: list[str], members: tuple[str, ...] = MEMBERS, days: DataFrame | None = None) -> ensemble.Portfolio:
    """The portfolio's ensemble for each fold. `days`: its daily totals under the same keys, needed for tree members."""
    own = materialize(series.filter(F.col("dimension_type") == P.OVERALL), "portfolio")
    if not set(members) - set(P.LINEAR_MEMBERS):
        return ensemble.fit_portfolio(own, keys, members)
    features = materialize(ensemble.feature_days(days, keys), "features")
    model = ensemble.fit_portfolio(own, keys, members, features)
    model = model._replace(seasonal=materialize(model.seasonal, "seasonal"), trees=materialize(model.trees, "trees"), newest=materialize(model.newest, "newest"))
    return ensemble.with_spread(model, features, keys, members)


def levels_out_of(models: DataFrame, portfolio: ensemble.Portfolio, anchors: DataFrame, campaign_map: DataFrame, start: Column,
                  folds: list[str] | None = None, members: tuple[str, ...] = MEMBERS, scales: DataFrame | None = None,
                  tuning: dict[str, float] | None = None) -> DataFrame:
    """Forecast of every entity out of what is fitted: p10, p50, p90 of revenue, and spend.

    The own forecasts, three rows an entity, are written once, as fallback and reconciliation
    read them again. The portfolio always keeps its own forecast, however short it is, since
    others fall back on it. `scales` and `tuning` are those of a stored state.
    """
    folds = list(folds or [])
    keys = [*folds, *ENTITY]
    tuning = {**PARAM_DEFAULTS, **(tuning or {})}
    weights = {"revenue_weight": tuning["model_blend_weight"], "spend_weight": tuning["spend_blend_weight"]}
    other = forecast.daily_forecast(models.filter(F.col("dimension_type") != P.OVERALL), anchors, start, keys, **weights)
    overall = ensemble.portfolio_daily(portfolio, anchors, start, keys, members, **weights)
    daily = other.select(*keys, *DAILY_COLUMNS).unionByName(overall.select(*keys, *DAILY_COLUMNS))
    own = materialize(forecast.horizon_intervals(daily, keys, tuning["interval_calibration_scale"]), "own")
    unseen = own.filter(~F.col("has_model")).select(*keys).distinct()
    if scales is None:
        totals = own.filter(F.col("forecast_period") == "30_days").select(
            *keys, F.col("total_revenue").alias("revenue"))
        scales = entities.fallback_scale(totals, folds)
    overall = own.filter(F.col("dimension_type") == P.OVERALL)
    other = forecast.unseen_forecast(unseen, overall, scales)
    own = own.filter(F.col("has_model")).unionByName(other.withColumns(
        {"has_model": F.lit(False), "total_revenue": F.lit(None).cast("double")}))
    return forecast.reconcile_campaigns(own, campaign_map, tuning["top_down_weight"], keys=folds)


def forecast_levels(series: DataFrame, campaign_map: DataFrame, start: Column,
                    folds: list[str] | None = None, members: tuple[str, ...] = MEMBERS, days: DataFrame | None = None) -> DataFrame:
    """Every entity (of every fold) fitted and forecast. `series` is read by several branches: hand in a materialized table."""
    folds = list(folds or [])
    keys = [*folds, *ENTITY]
    return levels_out_of(effects.fit_effects(series, keys), fit_portfolio(series, keys, members, days), recent_anchors(series, keys),
                         campaign_map, start, folds, members)


def next_day(series: DataFrame) -> Column:
    """The day after the newest one, as a constant."""
    last = series.agg(F.max("date").alias("d"))
    return F.date_add(scalar_of(last, "d")["d"], 1)


def prepare(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cube, series): the facts reduced once, and the entity series, both written
    to the shared folder since many branches read them."""
    cube = materialize(entities.daily_cube(facts), "cube")
    return cube, materialize(entities.entity_daily(cube), "series")


def full_forecast(facts: DataFrame, members: tuple[str, ...] = MEMBERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cube, series, forecast of all entities)."""
    cube, series = prepare(facts)
    days = ensemble.portfolio_days(cube) if set(members) - set(P.LINEAR_MEMBERS) else None
    fc = forecast_levels(series, entities.campaign_channels(cube), next_day(series), members=members, days=days)
    return cube, series, fc


def overall_daily(facts: DataFrame, members: tuple[str, ...] = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(the portfolio's next days, its spread): the Overall level alone, from one reduction of the facts."""
    totals = materialize(ensemble.portfolio_days(facts), "days")
    series = totals.select(*ENTITY, "date", F.col("revenue").cast("double").alias("revenue"), F.col("spend").cast("double").alias("spend"))
    model = fit_portfolio(series, ENTITY, members, totals)
    return ensemble.portfolio_daily(model, recent_anchors(series), next_day(series), ENTITY, members), model.spread


def overall_forecast(facts: DataFrame, members: tuple[str, ...] = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(the portfolio's three periods, its spread)."""
    daily, spread = overall_daily(facts, members)
    return forecast.horizon_intervals(daily), spread


def cube_and_predictions(facts: DataFrame, members: tuple[str, ...] = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(cube, predictions table), for those who need totals beside the forecast: one pass over the facts."""
    cube, _, fc = full_forecast(facts, members)
    return cube, forecast.predictions_long(fc, entities.top_campaigns(cube))


def predictions(facts: DataFrame, members: tuple[str, ...] = MEMBERS) -> DataFrame:
    """The predictions table: all channels and types, the ten leading campaigns."""
    return cube_and_predictions(facts, members)[1]
