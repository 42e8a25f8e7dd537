"""The portfolio's own forecast: a seasonal member by least squares and three boosted-tree members.

Everything carries key columns, so the portfolio of every fold is fitted side by side; the
same works for any other series. Members see the calendar and lagged features only, never
their own day.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.scalars import calendar_columns, with_calendar
from roaskit.operators import boosting
from roaskit.operators.anchor import damped_trend
from roaskit.operators.boosting import Learner
from roaskit.operators.entities import ENTITY
from roaskit.operators.features import WINDOWS, daily_totals, marketing_ratios, rolling_features
from roaskit.operators.forecast import blend, future_calendar
from roaskit.operators.leastsquares import fit_seasonal, seasonal_value

CALENDAR = ["month", "quarter", "week", "day_of_week", "is_weekend", "season_encoded"]
LAGGED = [f"{kind}_{w}d" for w in WINDOWS for kind in (
    "rolling_revenue", "rolling_spend", "rolling_roas", "rolling_conversion_rate",
    "moving_std_revenue", "moving_std_spend", "moving_std_roas", "variance_revenue",
    "trend_revenue")]
FEATURES = [*CALENDAR, *LAGGED]
#: How the tree members grow, what they predict, and how many of FEATURES they see.
LEARNERS = {
    "tree_a": (Learner(penalty=1.0), "revenue", len(FEATURES)),
    "tree_b": (Learner(penalty=0.0, least_rows=20), "revenue", len(FEATURES)),
    "tree_c": (Learner(penalty=3.0, level_split=True), "revenue", len(FEATURES)),
    "spend": (Learner(rounds=100, step=0.1, penalty=0.0, least_rows=20), "spend", len(CALENDAR)),
}


class Portfolio(NamedTuple):
    """A fitted ensemble: its tables hold one row (trees: one a member) for each key.

    Without tree members `trees` and `newest` are None, and the seasonal member gives the spend.
    """

    seasonal: DataFrame
    spread: DataFrame
    trees: DataFrame | None = None
    newest: DataFrame | None = None


def weights_of(members: tuple[str, ...]) -> dict[str, float]:
    """The weights of the members in use, scaled to come to 1."""
    total = sum(P.ENSEMBLE_WEIGHTS[m] for m in members)
    return {m: P.ENSEMBLE_WEIGHTS[m] / total for m in members}


def feature_days(days: DataFrame, keys: list[str]) -> DataFrame:
    """The features of each day, from the day's totals (keys, date, measures); what the first days lack is 0."""
    rows = rolling_features(marketing_ratios(with_calendar(days), clip=True), keys)
    return rows.select(*keys, "date", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                        for c in (*FEATURES, "revenue", "spend")])


def portfolio_days(cube: DataFrame) -> DataFrame:
    """The portfolio's totals a day, under its name."""
    return daily_totals(cube).select(F.lit(P.OVERALL).alias("dimension_type"), F.lit(P.PORTFOLIO).alias("dimension_value"), "*")


def member_values(model: Portfolio, rows: DataFrame, keys: list[str], members: tuple[str, ...]) -> DataFrame:
    """`rows` (keys, date, and FEATURES if there are trees) with raw, the weighted sum of the members, and m_spend."""
    cols = rows.columns
    out = rows.join(model.seasonal.select(*keys, "first_date", "last_date", "revenue_beta", "spend_beta"), keys)
    out = out.select(*cols, seasonal_value("revenue").alias("m_seasonal"), seasonal_value("spend").alias("m_spend"))
    if model.trees is not None:
        got = boosting.predict_trees(model.trees, boosting.frames(rows, keys, FEATURES, []), keys)
        names = [m for m in (*members, "spend") if m != "seasonal"]
        wide = got.groupBy(*keys, "date").pivot("member", names).agg(F.max("value"))
        wide = wide.select(*keys, "date", *[F.col(m).alias(f"m_{m}") for m in names])
        out = out.drop("m_spend").join(wide, [*keys, "date"])
    raw = sum((F.col(f"m_{m}") * F.lit(w) for m, w in weights_of(members).items()), F.lit(0.0))
    return out.withColumn("raw", raw)


def fit_portfolio(series: DataFrame, keys: list[str], members: tuple[str, ...] = tuple(P.ENSEMBLE_WEIGHTS),
                  features: DataFrame | None = None, learners: dict = LEARNERS) -> Portfolio:
    """Fits every series of `series` (keys, date, revenue, spend; a materialized table).

    Tree members need `features`, as `feature_days` makes them for the same keys and days,
    materialized too. The spread is that of the residuals of the whole ensemble.
    """
    seasonal = fit_seasonal(series, keys)
    if not set(members) - set(P.LINEAR_MEMBERS):
        return Portfolio(seasonal, seasonal.select(*keys, "revenue_std", "spend_std"))
    chosen = {m: learners[m] for m in (*members, "spend") if m in learners}
    newest = features.groupBy(*keys).agg(F.max_by(F.struct(*LAGGED), "date").alias("v")).select(*keys, "v.*")
    trees = boosting.fit_trees(boosting.frames(features, keys, FEATURES, ["revenue", "spend"]), keys, chosen)
    return Portfolio(seasonal, seasonal.select(*keys, "revenue_std", "spend_std"), trees, newest)


def with_spread(model: Portfolio, features: DataFrame, keys: list[str], members: tuple[str, ...]) -> Portfolio:
    """The model with the spread of the whole ensemble about the training days; its trees are a written table by now."""
    fit = member_values(model, features, keys, members)
    return model._replace(spread=fit.groupBy(*keys).agg(
        F.stddev_pop(F.col("revenue") - F.col("raw")).alias("revenue_std"), F.stddev_pop(F.col("spend") - F.col("m_spend")).alias("spend_std")))


def portfolio_daily(model: Portfolio, anchors: DataFrame, start: Column, keys: list[str] | None = None,
                    members: tuple[str, ...] = tuple(P.ENSEMBLE_WEIGHTS), days: int = P.MAX_HORIZON,
                    revenue_weight: float = P.MODEL_WEIGHT_REVENUE, spend_weight: float = P.MODEL_WEIGHT_SPEND) -> DataFrame:
    """keys, day, date, ensemble (members alone, at least 0), and revenue and spend blended with the anchor, std_daily.

    The future has the newest day's lagged features. `has_model` and `total_revenue` are there
    for the other levels' sake.
    """
    keys = list(keys or ENTITY)
    future = future_calendar(model.seasonal.select(*keys).withColumn("start_date", start), days=days).drop("start_date")
    if model.trees is not None:
        future = future.withColumns({k: c.cast("double") for k, c in calendar_columns().items()}).join(model.newest, keys)
    level = anchors.select(*keys, "daily_revenue", "daily_spend", "revenue_trend_per_day", "spend_trend_per_day")
    rows = (member_values(model, future, keys, members).join(level, keys, "left")
            .join(model.spread.select(*keys, "revenue_std"), keys, "left"))
    ensemble = F.greatest(F.lit(0.0), F.col("raw"))
    return rows.select(
        *keys, "day", "date", ensemble.alias("ensemble"),
        blend(ensemble, damped_trend("daily_revenue", "revenue_trend_per_day", "day"), revenue_weight, 0.0).alias("revenue"),
        blend(F.greatest(F.col("m_spend"), F.lit(1.0)), damped_trend("daily_spend", "spend_trend_per_day", "day"), spend_weight, 1.0).alias("spend"),
        F.coalesce("revenue_std", F.lit(P.DEFAULT_STD_OVERALL)).alias("std_daily"),
        F.lit(True).alias("has_model"), F.lit(None).cast("double").alias("total_revenue"))
