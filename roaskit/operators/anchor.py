"""Recent level and momentum of every series, deseasonalized where it matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.keyed import map_by_key, value_of, values_by_key
from roaskit.functions.scalars import clamp
from roaskit.operators.entities import ENTITY, last_rows, together

METRICS = ("revenue", "spend")


def month_means(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, month, revenue_mean, spend_mean: the mean day of a calendar month.

    Years in which the month totals nothing are left out; fewer than two years
    left give null.
    """
    keys = list(keys or ENTITY)
    return means_of_months(series.groupBy(*keys, F.month("date").alias("month"), F.year("date").alias("year")).agg(
        *[F.sum(F.col(m).cast("decimal(28,6)")).alias(m) for m in METRICS],
        F.count("*").alias("days")), keys)


def means_of_months(years: DataFrame, keys: list[str]) -> DataFrame:
    """The same, from the sums and days of each month of each year."""
    aggs = []
    for m in METRICS:
        live = F.col(m) > 0
        mean = F.sum(F.when(live, F.col(m))).cast("double") / F.sum(F.when(live, F.col("days")))
        aggs.append(F.when(F.count_if(live) >= P.MIN_SEASONAL_YEARS, mean).alias(f"{m}_mean"))
    return years.groupBy(*keys, "month").agg(*aggs)


def seasonal_index(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, revenue_index, spend_index: maps month -> month mean / median month mean.

    A map has at most 12 entries; it is null when no month has a mean or the
    median is not positive.
    """
    keys = list(keys or ENTITY)
    return index_of_means(month_means(series, keys), keys)


def index_of_means(means: DataFrame, keys: list[str]) -> DataFrame:
    """The same, from the mean day of each month."""
    months = range(1, 13)
    wide = means.groupBy(*keys).agg(*[c for m in METRICS for c in values_by_key("month", f"{m}_mean", months)])
    ordered = {m: F.sort_array(F.array_compact(F.array(*[value_of(f"{m}_mean", k) for k in months]))) for m in METRICS}
    wide = wide.withColumns({f"{m}_ordered": c for m, c in ordered.items()})
    median = {}
    for m in METRICS:
        n = F.size(f"{m}_ordered")
        low, high = (F.get(f"{m}_ordered", at.cast("int")) for at in (F.floor((n - 1) / 2), F.floor(n / 2)))
        median[f"{m}_ref"] = low * 0.5 + high * 0.5
    return wide.withColumns(median).select(*keys, *[
        F.when(F.col(f"{m}_ref") > 0, map_by_key(f"{m}_mean", months, over=F.col(f"{m}_ref"))).alias(f"{m}_index")
        for m in METRICS])


def seasonal_index_long(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The same as rows: keys, month, revenue_index, spend_index."""
    keys = list(keys or ENTITY)
    wide = seasonal_index(series, keys)
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    return (wide.select("*", months)
            .select(*keys, "month", *[F.element_at(f"{m}_index", F.col("month")).alias(f"{m}_index")
                                      for m in METRICS])
            .filter("revenue_index is not null or spend_index is not null"))


def _factor(m: str, month: Column) -> Column:
    return F.coalesce(F.element_at(f"{m}_index", month), F.lit(1.0))


def recent_anchors(series: DataFrame, keys: list[str] | None = None,
                   seasonal: bool = True) -> DataFrame:
    """Level and slope for each day ahead, for every series in one job.

    Level: mean of the last 30 observed rows. If the month after the last day has
    a seasonal factor at least twice, or at most half, the mean factor of these
    rows, they are divided by their factors and scaled to that month. Slope: mean
    of the newest 30 rows less that of the 30 before, a day, in the same way,
    within 3 % of the level. Shorter series have slope 0.
    """
    keys = list(keys or ENTITY)
    rows = together(series, keys)
    index = None
    if seasonal:                                      # a series without any mean has no index, whether in the join or not
        means = month_means(rows, keys).filter("revenue_mean is not null or spend_mean is not null")
        index = index_of_means(means, keys)
    return anchors_of(last_rows(rows, P.MOMENTUM_ROWS, keys), index, keys)


def anchors_of(recent: DataFrame, index: DataFrame | None, keys: list[str]) -> DataFrame:
    """The same, from the newest rows with their age and the seasonal index."""
    if index is not None:
        recent = recent.join(index, keys, "left")
    else:
        recent = recent.withColumns({f"{m}_index": F.lit(None).cast("map<int,double>")
                                     for m in METRICS})
    month = F.month("date")
    new, old = F.col("age") <= P.RECENT_ROWS, F.col("age") > P.RECENT_ROWS
    aggs = [F.max("date").alias("last_date"), F.count("*").alias("rows_used")]
    for m in METRICS:
        f = _factor(m, month)
        next_month = F.month(F.date_add("date", 1))
        aggs += [
            F.bool_or(F.col(f"{m}_index").isNotNull()).alias(f"{m}_indexed"),
            F.max(F.when(F.col("age") == 1, _factor(m, next_month))).alias(f"{m}_origin"),
            F.avg(F.when(new, f)).alias(f"{m}_factor"),
            F.avg(F.when(new, F.col(m))).alias(f"{m}_new"),
            F.avg(F.when(old, F.col(m))).alias(f"{m}_old"),
            F.avg(F.when(new, F.col(m) / f)).alias(f"{m}_new_flat"),
            F.avg(F.when(old, F.col(m) / f)).alias(f"{m}_old_flat"),
        ]
    g = recent.groupBy(*keys).agg(*aggs)
    out = {}
    for m in METRICS:
        origin = F.col(f"{m}_origin")
        ratio = origin / F.col(f"{m}_factor")
        fires = (F.col(f"{m}_indexed") & (F.col(f"{m}_factor") > 0)
                 & ((ratio >= P.SEASONAL_TRIGGER) | (ratio <= 1.0 / P.SEASONAL_TRIGGER)))
        level = F.when(fires, F.col(f"{m}_new_flat") * origin).otherwise(F.col(f"{m}_new"))
        slope = F.when(fires, (F.col(f"{m}_new_flat") - F.col(f"{m}_old_flat")) / 30.0 * origin) \
            .otherwise((F.col(f"{m}_new") - F.col(f"{m}_old")) / 30.0)
        cap = F.abs(level) * P.SLOPE_CAP
        out[m] = (level, F.when(F.col("rows_used") >= P.MOMENTUM_ROWS, clamp(slope, -cap, cap))
                  .otherwise(F.lit(0.0)), F.coalesce(fires, F.lit(False)))
    (rl, rs, rf), (sl, ss, sf) = out["revenue"], out["spend"]
    return g.select(
        *keys, "last_date", "rows_used",
        F.greatest(rl, F.lit(0.0)).alias("daily_revenue"),
        F.greatest(sl, F.lit(1.0)).alias("daily_spend"),
        rs.alias("revenue_trend_per_day"), ss.alias("spend_trend_per_day"),
        rf.alias("revenue_deseasonalized"), sf.alias("spend_deseasonalized"))


def damped_trend(level: Column | str, slope: Column | str, day: Column | str) -> Column:
    """Level plus a slope that fades: day i adds slope * i * 0.92^i."""
    lv, sl, d = (F.col(c) if isinstance(c, str) else c for c in (level, slope, day))
    return lv + sl * d * F.pow(F.lit(P.DAMPING), d.cast("double"))


def refresh_anchors(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored anchors brought up to date: entities in `fresh` replace their row,
    the others keep theirs. No model is fitted again."""
    cols = fresh.columns
    return fresh.unionByName(stored.select(*cols).join(fresh.select(*ENTITY), ENTITY, "left_anti"))
