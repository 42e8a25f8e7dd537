"""Portfolio risk from weekly series and channel shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.attach import attach
from roaskit.functions.scalars import clamp


def weekly_channel(cube: DataFrame) -> DataFrame:
    """channel, week (Monday), revenue, spend."""
    return cube.groupBy("channel", F.trunc("date", "week").alias("week")).agg(
        F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"))


def weekly_series(weekly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """[keys,] week, revenue, spend, roas of the whole portfolio or of each key."""
    g = weekly.groupBy(*(keys or []), "week").agg(
        F.sum("revenue").cast("double").alias("revenue"),
        F.sum("spend").cast("double").alias("spend"))
    return g.withColumn("roas", F.col("revenue") / (F.col("spend") + P.EPS))


def variation(c: str) -> Column:
    """Sample deviation over mean of the positive values; 0 for a single week."""
    v = F.when(F.col(c) > 0, F.col(c))
    return F.coalesce(F.stddev_samp(v) / (F.avg(v) + P.EPS), F.lit(0.0))


def weekly_variation(weekly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    s = weekly_series(weekly, keys)
    aggs = [variation("revenue").alias("revenue_cv"), variation("roas").alias("roas_cv"),
            F.count_if(F.col("roas") > 0).alias("weeks")]
    return s.groupBy(*keys).agg(*aggs) if keys else s.agg(*aggs)


def channel_shares(weekly: DataFrame) -> DataFrame:
    """channel, revenue, share of all revenue."""
    ch = weekly.groupBy("channel").agg(F.sum("revenue").cast("double").alias("revenue"))
    total = ch.agg(F.sum("revenue").alias("_t"))
    return attach(ch, total).select("channel", "revenue", (F.col("revenue") / F.col("_t")).alias("share"))


def concentration(weekly: DataFrame) -> DataFrame:
    """One row: sum of squared shares, the leading channel and its share in percent."""
    lead = F.min(F.struct((-F.col("share")).alias("s"), "channel"))
    return channel_shares(weekly).agg(
        F.sum(F.pow("share", F.lit(2.0))).alias("hhi"), lead["channel"].alias("top_channel"),
        F.bround(F.max("share") * 100.0, 1).alias("top_share_pct"))


def most_volatile_channel(weekly: DataFrame) -> DataFrame:
    """One row: the channel whose weekly roas varies most, of those with two weeks."""
    v = weekly_variation(weekly, ["channel"]).filter("weeks >= 2")
    return v.agg(F.min(F.struct((-F.col("roas_cv")).alias("n"), "channel"))["channel"]
                 .alias("volatile_channel"))


def risk_profile(weekly: DataFrame, quality: float | Column) -> DataFrame:
    """One row: four factor scores (0..100), the weighted score and its class.

    `weekly` is channel-week rows; all parts are single rows carried as constants.
    """
    q = quality if isinstance(quality, Column) else F.lit(float(quality))
    base = attach(attach(weekly_variation(weekly), concentration(weekly)),
                  most_volatile_channel(weekly))

    def score(c: Column) -> Column:
        return clamp(c, 0.0, 100.0)

    rows = base.withColumns({
        "revenue_volatility": score(F.col("revenue_cv") * 100.0),
        "channel_dependency": score((F.col("hhi") - 0.33) * 150.0),
        "roas_instability": score(F.col("roas_cv") * 120.0),
        "data_quality": F.lit(100.0) - q, "quality_score": q})
    w = P.RISK_WEIGHTS
    total = (w[0] * F.col("revenue_volatility") + w[1] * F.col("channel_dependency")
             + w[2] * F.col("roas_instability") + w[3] * F.col("data_quality"))
    rows = rows.withColumn("risk_score", F.bround(total, 1))
    label = (F.when(F.col("risk_score") < 35, "Low Risk").when(F.col("risk_score") < 65, "Medium Risk")
             .otherwise("High Risk"))
    return rows.select("risk_score", label.alias("risk_classification"), "revenue_volatility",
                       "channel_dependency", "roas_instability", "data_quality", "quality_score",
                       "hhi", "top_channel", "top_share_pct", "volatile_channel")


def risk_factors(profile: DataFrame) -> DataFrame:
    """Four rows: name, score, status, impact, mitigation."""
    volatile = F.coalesce("volatile_channel", F.lit("the weaker"))
    rows = [
        ("Revenue Volatility", "revenue_volatility", "High",
         F.when(F.col("revenue_volatility") < 40, "Healthy").otherwise("Monitor"),
         F.lit("Pace spend evenly over the week to steady revenue.")),
        ("Channel Dependency", "channel_dependency", "Medium",
         F.when(F.col("channel_dependency") > 50, "Concentrated").otherwise("Diversified"),
         F.concat(F.format_string("%s brings %.1f%% of revenue. ", "top_channel", "top_share_pct"),
                  F.when(F.col("channel_dependency") > 50, "Build up a second channel.")
                  .otherwise("That share is sound; keep watching it."))),
        ("ROAS Instability", "roas_instability", "High",
         F.when(F.col("roas_instability") > 50, "Volatile").otherwise("Stable"),
         F.concat(F.lit("Set bid floors on return for "), volatile, F.lit(" campaigns."))),
        ("Data Quality Audit", "data_quality", "Low",
         F.when(F.col("data_quality") < 10, "Excellent").otherwise("Action Required"),
         F.format_string("Exports score %.1f of 100; keep tracking tags complete.", "quality_score")),
    ]
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.bround(F.col(c), 1).alias("score"),
                               st.alias("status"), F.lit(im).alias("impact"),
                               mi.alias("mitigation")) for n, c, im, st, mi in rows])
    return profile.select(F.explode(cells).alias("f")).select("f.*")
