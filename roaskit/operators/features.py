"""Engineered tables: daily, channel-day and campaign features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roaskit.functions.attach import small_side
from roaskit.functions.scalars import clamp, dbl, guarded_ratio, with_calendar

MEASURES = ("spend", "revenue", "clicks", "impressions", "conversions")
WINDOWS = (7, 14, 30)


def daily_totals(cube: DataFrame) -> DataFrame:
    return cube.groupBy("date").agg(*[F.sum(m).alias(m) for m in MEASURES])


def marketing_ratios(df: DataFrame, clip: bool) -> DataFrame:
    """cpc, cpa, ctr, conversion_rate, roas; clipped to sane ranges when asked."""
    ratios = {
        "cpc": (guarded_ratio("spend", "clicks"), 100.0),
        "cpa": (guarded_ratio("spend", "conversions"), 1000.0),
        "ctr": (guarded_ratio("clicks", "impressions"), 1.0),
        "conversion_rate": (guarded_ratio("conversions", "clicks"), 1.0),
    }
    cols = {n: (clamp(c, 0.0, top) if clip else c) for n, (c, top) in ratios.items()}
    return df.withColumns({**cols, "roas": guarded_ratio("revenue", "spend")})


def rolling_features(daily: DataFrame, keys: list[str] | None = None,
                     windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Means, deviations, variance and trend of the w rows before each day.

    The frame ends before the current row, so no feature sees its own day. All
    windows share one partitioning and order: one shuffle, one sort. `keys` name
    the series; without keys the table is one series, and holds one row a day.
    """
    keys = list(keys or [])
    order = Window.partitionBy(*keys).orderBy("date")
    whole = Window.partitionBy(*keys)

    def mean(col: str, w) -> Column:
        # Sums of decimals are exact in any order, so the mean is reproducible.
        return F.sum(col).over(w).cast("double") / F.count(col).over(w)

    cols, later = {}, {}
    lag_rev = F.lag("revenue", 1).over(order).cast("double")
    for w in windows:
        frame = order.rowsBetween(-w, -1)
        for m in ("revenue", "spend", "roas", "conversion_rate"):
            cols[f"rolling_{m}_{w}d"] = F.coalesce(
                F.when(F.count(m).over(frame) > 0, mean(m, frame)), mean(m, whole))
        for m in ("revenue", "spend", "roas"):
            cols[f"moving_std_{m}_{w}d"] = F.coalesce(
                F.stddev_samp(dbl(m)).over(frame), F.lit(0.0))
        later[f"variance_revenue_{w}d"] = F.pow(F.col(f"moving_std_revenue_{w}d"), F.lit(2.0))
        base = F.col(f"rolling_revenue_{w}d")
        later[f"trend_revenue_{w}d"] = (F.col("_lag_revenue") - base) / (base + 1e-5)
    return (daily.withColumns({**cols, "_lag_revenue": lag_rev}).withColumns(later)
            .drop("_lag_revenue"))


def daily_features(cube: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """One row a day: totals, calendar, ratios, rolling features (45 columns)."""
    base = marketing_ratios(with_calendar(daily_totals(cube)), clip=True)
    return rolling_features(base, windows=windows)


def channel_features(cube: DataFrame) -> DataFrame:
    """One row a day and channel, with its share of the day.

    The day's totals come from a window over the channel-day rows: a day has as
    many of them as there are channels.
    """
    day = Window.partitionBy("date")
    rows = cube.groupBy("date", "channel").agg(*[F.sum(m).alias(m) for m in MEASURES])
    rows = rows.withColumns({"total_daily_spend": F.sum("spend").over(day),
                             "total_daily_revenue": F.sum("revenue").over(day)})
    ratios = {
        "spend_share": guarded_ratio("spend", "total_daily_spend"),
        "revenue_share": guarded_ratio("revenue", "total_daily_revenue"),
        "roas": guarded_ratio("revenue", "spend"),
        "cpc": guarded_ratio("spend", "clicks"),
        "ctr": guarded_ratio("clicks", "impressions"),
    }
    return rows.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in ratios.items()})


def campaign_features(facts: DataFrame) -> DataFrame:
    """Fact rows with their ratios; a projection, no shuffle."""
    return marketing_ratios(facts, clip=False).drop("conversion_rate").fillna(0.0)


def enrich_facts(facts: DataFrame, daily: DataFrame) -> DataFrame:
    """Every fact row with its day's engineered columns.

    The daily side has one row a day: it is written, counted and broadcast, so facts don't move.
    """
    extra = [c for c in daily.columns if c not in MEASURES]
    return facts.join(small_side(daily.select(*extra), "daily"), "date", "left")


def last_known(daily: DataFrame) -> DataFrame:
    """One row: the newest day's engineered values, to be carried to future days."""
    cols = [c for c in daily.columns if c not in (*MEASURES, "date", "month", "quarter", "week",
                                                  "day_of_week", "is_weekend", "season",
                                                  "season_encoded")]
    return daily.agg(F.max_by(F.struct(*cols), "date").alias("v")).select("v.*")


def write_features(enriched: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Enriched facts as Parquet partitioned by year, or CSV."""
    if fmt == "parquet":
        (enriched.withColumn("year", F.year("date")).write.mode("overwrite")
         .partitionBy("year").parquet(path))
    elif fmt == "csv":
        enriched.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
