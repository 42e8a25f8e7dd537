"""What moves revenue and roas: driver matrix and importance measures."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roaskit.functions.attach import attach
from roaskit.functions.scalars import guarded_ratio
from roaskit.operators.leastsquares import normal_sums, solved

DRIVERS = ("spend", "clicks", "impressions", "cpc", "ctr", "month", "day_of_week",
           "channel_encoded")
# How a driver is called in reports.
DRIVER_LABELS = {
    "spend": "Ad Spend Allocation ($)",
    "clicks": "Traffic Clicks Volume",
    "impressions": "Ad Impressions / Reach",
    "cpc": "Cost Per Click (CPC) Inflation",
    "ctr": "Click-Through Rate (CTR) Efficiency",
    "month": "Seasonality (Month of Year)",
    "day_of_week": "Day of Week Trends",
    "channel_encoded": "Acquisition Channel Mix",
}


def driver_matrix(cube: DataFrame) -> DataFrame:
    """One row a day and channel with the eight drivers and both targets.

    Channels are coded by their place in the alphabet, from the few distinct names.
    """
    rows = cube.groupBy("date", "channel").agg(
        *[F.sum(m).cast("double").alias(m) for m in ("spend", "revenue", "clicks", "impressions")])
    names = rows.select("channel").distinct().agg(F.array_sort(F.collect_list("channel")).alias("_ch"))
    return attach(rows, names).select(
        "date", "channel", "spend", "revenue", "clicks", "impressions",
        guarded_ratio("revenue", "spend").alias("roas"),
        guarded_ratio("spend", "clicks").alias("cpc"),
        guarded_ratio("clicks", "impressions").alias("ctr"),
        F.month("date").alias("month"), F.weekday("date").alias("day_of_week"),
        F.array_position("_ch", F.col("channel")).cast("int").alias("channel_encoded"))


def _target(matrix: DataFrame, target: str) -> DataFrame:
    y = F.least(F.col("roas"), F.lit(20.0)) if target == "roas" else F.col(target)
    return matrix.select(*[F.coalesce(F.col(d).cast("double"), F.lit(0.0)).alias(d)
                           for d in DRIVERS], y.alias("label"))


def _ranked(long: DataFrame) -> DataFrame:
    label = F.create_map(*[F.lit(x) for kv in DRIVER_LABELS.items() for x in kv])
    return long.select("feature", F.element_at(label, F.col("feature")).alias("label"),
                       "impact").orderBy(F.col("impact").desc(), "feature")


def linear_importance(matrix: DataFrame, target: str = "revenue") -> DataFrame:
    """feature, label, impact: mean absolute Shapley value of a linear model.

    For a linear model the Shapley value of a driver is its weight times its
    distance from its mean. Drivers are standardized, so one aggregate gives means and
    spreads, one the sums of the normal equations, and one the mean distances; a driver
    that doesn't vary has no impact. `matrix` is read three times: hand in a table.
    """
    rows = _target(matrix, target)
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in (*DRIVERS, "label")], *[F.stddev_pop(d).alias(f"_s_{d}") for d in DRIVERS])
    varies = {d: F.col(f"_s_{d}") > F.abs(f"_m_{d}") * 1e-9 for d in DRIVERS}
    far = attach(rows, stats).select(
        *[F.when(varies[d], (F.col(d) - F.col(f"_m_{d}")) / F.col(f"_s_{d}")).otherwise(0.0).alias(d) for d in DRIVERS],
        (F.col("label") - F.col("_m_label")).alias("label"))
    weights = solved(normal_sums(far, [], F.array(*DRIVERS), len(DRIVERS), ("label",)), len(DRIVERS), ("label",))
    mean = attach(far.agg(*[F.avg(F.abs(d)).alias(d) for d in DRIVERS]), weights)
    return _ranked(mean.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("feature"), (F.abs(F.get("label_beta", F.lit(i))) * F.col(d)).alias("impact"))
        for i, d in enumerate(DRIVERS)])).alias("p")).select("p.*"))


def fit_tree_model(matrix: DataFrame, target: str = "revenue", trees: int = 100, depth: int = 5):
    rows = _target(matrix, target)
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(DRIVERS), outputCol="features"),
        GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=42)]).fit(rows)


def tree_importance(matrix: DataFrame, target: str = "revenue", trees: int = 100,
                    depth: int = 5) -> DataFrame:
    """feature, label, impact: the boosted trees' own importances (they sum to 1)."""
    weights = fit_tree_model(matrix, target, trees, depth).stages[-1].featureImportances
    cells = F.array(*[F.struct(F.lit(d).alias("feature"), F.lit(float(weights[i])).alias("impact"))
                      for i, d in enumerate(DRIVERS)])
    return _ranked(matrix.limit(1).select(F.explode(cells).alias("c")).select("c.*"))


def permutation_importance(matrix: DataFrame, model, target: str = "revenue") -> DataFrame:
    """feature, label, impact: rise of the mean absolute error when a driver is swapped
    for that of the row next in hash order within its day's month.

    One job: each row appears once for every driver, with that driver exchanged.
    Swapping stays within a month and channel: a group is at most 31 days a year.
    """
    rows = matrix.withColumn("_y", F.year("date"))
    w = Window.partitionBy("month", "_y").orderBy(F.xxhash64("date", "channel"), "date", "channel")
    first = Window.partitionBy("month", "_y").orderBy(
        F.xxhash64("date", "channel"), "date", "channel").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    base = rows.withColumns({f"_n_{d}": F.coalesce(F.lead(d).over(w), F.first(d).over(first))
                             for d in DRIVERS})
    which = F.explode(F.array(F.lit("(none)"), *[F.lit(d) for d in DRIVERS]))
    wide = base.withColumn("feature", which)
    swapped = wide.select(
        "feature", F.col("roas"), F.col("revenue"), *[
            F.when(F.col("feature") == d, F.col(f"_n_{d}")).otherwise(F.col(d))
            .cast("double").alias(d) for d in DRIVERS])
    y = F.least(F.col("roas"), F.lit(20.0)) if target == "roas" else F.col(target)
    err = model.transform(swapped).groupBy("feature").agg(
        F.avg(F.abs(y - F.col("prediction"))).alias("mae"))
    none = err.filter("feature = '(none)'").select(F.col("mae").alias("_base"))
    return _ranked(attach(err.filter("feature <> '(none)'"), none).select(
        "feature", (F.col("mae") - F.col("_base")).alias("impact")))


def channel_importance(cube: DataFrame) -> DataFrame:
    """channel, share of revenue, stability label, score against the leading channel."""
    g = cube.groupBy("channel").agg(F.sum("revenue").cast("double").alias("revenue"),
                                    F.sum("spend").cast("double").alias("spend"))
    tops = g.agg(F.max("revenue").alias("_max"), F.sum("revenue").alias("_sum"))
    roas = guarded_ratio("revenue", "spend")
    level = F.when(roas >= 4.0, "High").when(roas >= 2.5, "Medium").otherwise("Low")
    return attach(g, tops).select(
        "channel",
        F.when(F.col("_sum") > 0, F.bround(F.col("revenue") / F.col("_sum") * 100.0, 1))
        .otherwise(F.lit(0.0)).alias("contribution_share"),
        F.format_string("%s (Historical ROAS: %.1fx)", level, roas).alias("roas_stability"),
        F.when(F.col("_max") > 0, F.bround(F.col("revenue") / F.col("_max") * 95.0, 0).cast("int"))
        .otherwise(F.lit(0)).alias("importance_score"))


def campaign_totals(cube: DataFrame) -> DataFrame:
    g = cube.groupBy("channel", "campaign_name").agg(
        F.sum("revenue").cast("double").alias("total_historical_revenue"),
        F.sum("spend").cast("double").alias("spend"))
    roas = guarded_ratio("total_historical_revenue", "spend")
    return g.select("channel", "campaign_name", "total_historical_revenue",
                    roas.alias("average_roas"),
                    F.when(roas >= 4.0, "Primary Bedrock").otherwise("Volume Accelerator")
                    .alias("driver_status"))


def campaign_importance(cube: DataFrame, n: int = 8) -> DataFrame:
    """The n leading campaigns (within a channel) by revenue."""
    return campaign_totals(cube).orderBy(F.col("total_historical_revenue").desc(), "channel",
                                         "campaign_name").limit(n)


def sort_campaigns(campaigns: DataFrame, mode: str = "revenue", n: int = 3) -> DataFrame:
    """The first n by revenue, by best or by worst roas."""
    keys = {"revenue": F.col("total_historical_revenue").desc(),
            "best": F.col("average_roas").desc(), "worst": F.col("average_roas").asc()}
    if mode not in keys:
        raise ValueError(f"unknown order {mode!r}")
    return campaigns.orderBy(keys[mode], "channel", "campaign_name").limit(n)
