"""Scoring without fitting: a forecast out of stored state and the newest facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.operators import effects, ensemble, entities, forecast
from roaskit.operators.anchor import recent_anchors, refresh_anchors
from roaskit.operators.entities import ENTITY
from roaskit.plans.forecasting import MEMBERS, fit_portfolio, levels_out_of, next_day, prepare
from roaskit.sources import state
from roaskit.sources.storage import materialize


def fit_state(facts: DataFrame, members: tuple[str, ...] = MEMBERS, **params: float) -> dict[str, DataFrame]:
    """Everything a forecast needs, fitted on `facts`, as the tables of a state."""
    cube, series = prepare(facts)
    days = ensemble.portfolio_days(cube) if set(members) - set(P.LINEAR_MEMBERS) else None
    portfolio = fit_portfolio(series, ENTITY, members, days)
    models = materialize(effects.fit_effects(series), "models")
    totals = models.select(*ENTITY, F.col("total_revenue").alias("revenue"))
    out = {"entity_model": models, "entity_baseline": recent_anchors(series), "portfolio_seasonal": portfolio.seasonal,
           "portfolio_spread": portfolio.spread, "campaign_map": entities.campaign_channels(cube),
           "fallback_scale": entities.fallback_scale(totals), "params": state.params_table(facts.sparkSession, **params)}
    if portfolio.trees is not None:
        out |= {"portfolio_trees": portfolio.trees, "portfolio_newest": portfolio.newest}
    return out


def predict_from_state(spark: SparkSession, facts: DataFrame, path: str) -> DataFrame:
    """The predictions table of the entities in `facts`, by the models stored at `path`.

    Anchors and the newest lagged features are taken from `facts`, as are the leading campaigns
    and the first day; models, shares and scales are the stored ones. An entity that the state
    does not know is forecast from the portfolio. Without a sound state it raises; it never fits.
    """
    stored = state.load_state(spark, path)
    cube, series = prepare(facts)
    anchors = materialize(refresh_anchors(stored["entity_baseline"], recent_anchors(series)), "anchors")
    here = series.select(*ENTITY).distinct()
    models = here.join(stored["entity_model"], ENTITY, "left").withColumn("has_model", F.coalesce("has_model", F.lit(False)))
    trees = stored.get("portfolio_trees")
    members, newest = P.LINEAR_MEMBERS, None
    if trees is not None:
        members = tuple(P.ENSEMBLE_WEIGHTS)
        features = ensemble.feature_days(ensemble.portfolio_days(cube), ENTITY)
        newest = features.groupBy(*ENTITY).agg(F.max_by(F.struct(*ensemble.LAGGED), "date").alias("v")).select(*ENTITY, "v.*")
    portfolio = ensemble.Portfolio(stored["portfolio_seasonal"], stored["portfolio_spread"], trees, newest)
    fc = levels_out_of(models, portfolio, anchors, stored["campaign_map"], next_day(series), members=members,
                       scales=stored["fallback_scale"], tuning=state.params_of(stored["params"]))
    return forecast.predictions_long(fc, entities.top_campaigns(cube))
