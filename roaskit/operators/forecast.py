"""Forecasts of all entities in one job: blend, intervals, fallback, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.attach import scalar_of
from roaskit.functions.scalars import calendar_columns, confidence_label, confidence_pct
from roaskit.operators.anchor import damped_trend
from roaskit.operators.effects import fitted_value
from roaskit.operators.entities import ENTITY


def future_calendar(starts: DataFrame, start: str = "start_date", days: int = P.MAX_HORIZON
                    ) -> DataFrame:
    """Each row of `starts` for days 1..n ahead: `day`, `date`."""
    return (starts.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
            .withColumn("date", F.date_add(F.col(start), F.col("day") - 1)))


def future_features(starts: DataFrame, start: str = "start_date", days: int = P.MAX_HORIZON
                    ) -> DataFrame:
    return future_calendar(starts, start, days).withColumns(calendar_columns())


def blend(model: Column, anchor: Column, weight: float, floor: float) -> Column:
    """weight x model + rest x anchor, at least `floor`; without an anchor the model."""
    mixed = F.greatest(F.lit(weight) * model + F.lit(1.0 - weight) * anchor, F.lit(floor))
    return F.when(anchor.isNotNull(), mixed).otherwise(model)


def daily_forecast(models: DataFrame, anchors: DataFrame, start: Column,
                   keys: list[str] | None = None,
                   revenue_weight: float = P.MODEL_WEIGHT_REVENUE,
                   spend_weight: float = P.MODEL_WEIGHT_SPEND) -> DataFrame:
    """keys, day, date, revenue, spend, std_daily: the next 90 days of every series.

    `start` is the first day: a constant, or a column of `models`. `has_model` and
    `total_revenue` of the models are passed on.
    """
    keys = list(keys or ENTITY)
    level = anchors.select(*keys, "daily_revenue", "daily_spend", "revenue_trend_per_day",
                           "spend_trend_per_day")
    rows = future_calendar(models.withColumn("start_date", start).join(level, keys, "left"))
    overall = F.col("dimension_type") == P.OVERALL
    rev_model = F.greatest(fitted_value("revenue"), F.lit(0.0))
    sp_model = F.greatest(fitted_value("spend"), F.when(overall, 1.0).otherwise(0.1))
    rev_anchor = damped_trend("daily_revenue", "revenue_trend_per_day", "day")
    sp_anchor = damped_trend("daily_spend", "spend_trend_per_day", "day")
    std = F.coalesce("revenue_std", F.when(overall, P.DEFAULT_STD_OVERALL)
                     .otherwise(P.DEFAULT_STD_ENTITY))
    return rows.select(
        *keys, "day", "date",
        blend(rev_model, rev_anchor, revenue_weight, 0.0).alias("revenue"),
        blend(sp_model, sp_anchor, spend_weight, 1.0).alias("spend"),
        std.alias("std_daily"), "has_model", "total_revenue")


def interval_columns(p50: Column, std: Column, days: Column | int,
                     scale: float = P.INTERVAL_SCALE) -> dict[str, Column]:
    """P10/P50/P90 of a horizon's sum; the spread grows with days^0.75."""
    d = F.lit(float(days)) if isinstance(days, int) else days.cast("double")
    half = F.lit(P.Z_80) * std * F.pow(d, F.lit(P.HORIZON_POWER)) * F.lit(scale)
    zero = F.lit(0.0)
    return {
        "p10": F.greatest(zero, F.greatest(p50 * P.P10_FLOOR, p50 - half)),
        "p50": F.greatest(zero, p50),
        "p90": F.greatest(zero, p50 + half),
    }


def horizon_intervals(daily: DataFrame, keys: list[str] | None = None,
                      scale: float = P.INTERVAL_SCALE) -> DataFrame:
    """keys, forecast_period, p10, p50, p90 of revenue, and spend.

    The three horizons are conditional sums of one grouping, unfolded after it.
    """
    keys = list(keys or ENTITY)
    carried = [c for c in ("has_model", "total_revenue") if c in daily.columns]
    aggs = [F.max(c).alias(c) for c in ("std_daily", *carried)]
    for label, h in P.HORIZONS.items():
        near = F.col("day") <= h
        aggs += [F.sum(F.when(near, F.col("revenue"))).alias(f"r_{label}"),
                 F.sum(F.when(near, F.col("spend"))).alias(f"s_{label}")]
    g = daily.groupBy(*keys).agg(*aggs)
    per = F.explode(F.array(*[
        F.struct(F.lit(label).alias("forecast_period"), F.lit(h).alias("days"),
                 F.col(f"r_{label}").alias("sum_revenue"), F.col(f"s_{label}").alias("spend"))
        for label, h in P.HORIZONS.items()]))
    rows = g.select(*keys, "std_daily", *carried, per.alias("h")).select(
        *keys, "std_daily", *carried, "h.*")
    cols = interval_columns(F.col("sum_revenue"), F.col("std_daily"), F.col("days"), scale)
    return rows.select(*keys, "forecast_period", *[c.alias(n) for n, c in cols.items()], "spend",
                       *carried)


def unseen_forecast(unseen: DataFrame, overall: DataFrame, scales: DataFrame) -> DataFrame:
    """Forecast of entities without a model: the portfolio's, scaled, twice as wide.

    `unseen` and `overall` carry the same fold columns, if any, beside the entity.
    """
    folds = [c for c in unseen.columns if c not in ENTITY]
    base = overall.select(*folds, "forecast_period", F.col("p10").alias("o10"),
                          F.col("p50").alias("o50"), F.col("p90").alias("o90"),
                          F.col("spend").alias("ospend"))
    if folds:
        rows = unseen.join(base, folds)
    else:
        # Three portfolio rows as one constant array: no cross product.
        cells = scalar_of(base.agg(F.collect_list(F.struct(
            "forecast_period", "o10", "o50", "o90", "ospend")).alias("b")), "b")["b"]
        rows = unseen.select("*", F.explode(cells).alias("b")).select(*ENTITY, "b.*")
    default = F.lit(0.1)
    for kind, s in P.FALLBACK_SCALE.items():
        default = F.when(F.col("dimension_type") == kind, F.lit(s)).otherwise(default)
    rows = rows.join(scales, [*folds, "dimension_type"], "left").withColumn(
        "_s", F.coalesce("scale", default))
    p50 = F.col("o50") * F.col("_s")
    half = (F.col("o90") - F.col("o10")) * F.col("_s")
    return rows.select(
        *ENTITY, *folds, "forecast_period",
        F.greatest(F.lit(0.0), p50 - half).alias("p10"), p50.alias("p50"),
        F.greatest(F.lit(0.0), p50 + half).alias("p90"), (F.col("ospend") * F.col("_s")).alias("spend"))


def reconcile_campaigns(forecast: DataFrame, campaign_map: DataFrame,
                        weight: float = P.TOP_DOWN_WEIGHT, keys: list[str] | None = None
                        ) -> DataFrame:
    """Campaigns pulled to their share of their channel's forecast; others as they are.

    P10 and P90 move in the proportion of P50. Campaigns without a share, a channel,
    or a model of their own stay.
    """
    keys = list(keys or [])
    channel = (forecast.filter(F.col("dimension_type") == P.CHANNEL)
               .select(*keys, F.col("dimension_value").alias("channel"), "forecast_period",
                       F.col("p50").alias("_ch50")))
    share = campaign_map.select(*keys, F.lit(P.CAMPAIGN).alias("dimension_type"),
                                F.col("campaign_name").alias("dimension_value"),
                                "channel", "channel_share")
    rows = (forecast.join(share, [*keys, *ENTITY], "left")
            .join(channel, [*keys, "channel", "forecast_period"], "left"))
    applies = (F.col("_ch50").isNotNull() & (F.col("channel_share") > 0)
               & (F.col("has_model") if "has_model" in forecast.columns else F.lit(True)))
    target = F.lit(1.0 - weight) * F.col("p50") + F.lit(weight) * F.col("_ch50") * F.col("channel_share")
    factor = F.when(F.col("p50") > 0, target / F.col("p50")).otherwise(F.lit(1.0))
    return rows.select(
        *keys, *ENTITY, "forecast_period",
        F.when(applies, F.greatest(F.lit(0.0), F.col("p10") * factor)).otherwise(F.col("p10")).alias("p10"),
        F.when(applies, target).otherwise(F.col("p50")).alias("p50"),
        F.when(applies, F.col("p90") * factor).otherwise(F.col("p90")).alias("p90"),
        "spend")


def predictions_long(forecast: DataFrame, top: DataFrame | None = None,
                     keys: list[str] | None = None) -> DataFrame:
    """Tidy table: period, dimension, metric (Revenue, ROAS), p10, p50, p90 to 2 digits.

    With `top` only its campaigns stay; all channels and types do.
    """
    keys = list(keys or [])
    if top is not None:
        chosen = top.select(*keys, F.lit(P.CAMPAIGN).alias("dimension_type"),
                            F.col("campaign_name").alias("dimension_value"))
        camps = forecast.filter(F.col("dimension_type") == P.CAMPAIGN).join(
            chosen, [*keys, *ENTITY], "left_semi")
        forecast = forecast.filter(F.col("dimension_type") != P.CAMPAIGN).unionByName(camps)
    qs = ("p10", "p50", "p90")
    roas = {q: F.when(F.col("spend") > 0, F.col(q) / F.col("spend")).otherwise(F.lit(0.0))
            for q in qs}
    metrics = F.array(
        F.struct(F.lit("Revenue").alias("metric"), *[F.col(q).alias(q) for q in qs]),
        F.struct(F.lit("ROAS").alias("metric"), *[roas[q].alias(q) for q in qs]))
    return (forecast.select(*keys, "forecast_period", *ENTITY, F.explode(metrics).alias("m"))
            .select(*keys, "forecast_period", *ENTITY, "m.metric",
                    *[F.bround(f"m.{q}", 2).alias(q) for q in qs]))


def report_order(predictions: DataFrame) -> DataFrame:
    """Sorted for a sink: level, entity, period, Revenue first."""
    level = F.array_position(F.array(*[F.lit(x) for x in P.LEVELS]), F.col("dimension_type"))
    return predictions.orderBy(level, "dimension_value", "forecast_period", F.col("metric").desc())


def daily_trajectory(ensemble_daily: DataFrame, std: Column, p50: str = "ensemble") -> DataFrame:
    """day, p10, p50, p90 of the raw ensemble: no anchor is blended in here."""
    d = F.col("day")
    half = F.lit(P.Z_80) * std * F.pow(d.cast("double"), F.lit(P.HORIZON_POWER))
    return ensemble_daily.select(
        "day", F.bround(F.greatest(F.lit(0.0), F.col(p50) - half), 2).alias("p10"),
        F.bround(p50, 2).alias("p50"), F.bround(F.col(p50) + half, 2).alias("p90"))


def forecast_document(predictions: DataFrame, dimension: str) -> DataFrame:
    """One row a period with Revenue and ROAS quantiles of `dimension`.

    A dimension the table does not have answers with the portfolio. The choice is
    an existence test, run as a scalar subquery.
    """
    if dimension == P.OVERALL:
        rows = predictions.filter(F.col("dimension_type") == P.OVERALL)
    else:
        match = predictions.filter(F.col("dimension_value") == dimension)
        found = match.limit(1).agg(F.count("*").alias("n"))
        known = scalar_of(found, "n")["n"] > 0
        rows = predictions.filter(
            (known & (F.col("dimension_value") == dimension))
            | (~known & (F.col("dimension_type") == P.OVERALL)))
    return rows.groupBy("forecast_period").pivot("metric", ["Revenue", "ROAS"]).agg(
        F.max("p10").alias("P10"), F.max("p50").alias("P50"), F.max("p90").alias("P90"))


def with_confidence(predictions: DataFrame) -> DataFrame:
    pct = confidence_pct("p10", "p50", "p90")
    return (predictions.withColumn("confidence_pct", pct)
            .withColumn("confidence", confidence_label("confidence_pct", "p50")))


def top_per_fold(campaign_revenue: DataFrame, fold: str, n: int = P.TOP_CAMPAIGNS) -> DataFrame:
    """The n leading campaigns of each fold; the rank filter cuts each task to n first."""
    w = Window.partitionBy(fold).orderBy(F.col("revenue").desc(), "campaign_name")
    return campaign_revenue.withColumn("_r", F.row_number().over(w)).filter(
        F.col("_r") <= n).drop("_r")
