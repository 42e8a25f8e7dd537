"""Rolling-origin backtest: all folds in one job, scored against a naive baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.attach import attach
from roaskit.functions.scalars import ape, rmse, safe_ratio, smape, wape
from roaskit.operators.entities import ENTITY

FOLD = "origin_date"


def make_origins(series: DataFrame, folds: int, horizon: int = P.MAX_HORIZON,
                 min_train: int = P.MIN_TRAIN_DAYS) -> DataFrame:
    """One row, `origins`: forecast dates spread evenly over the usable history.

    The first leaves `min_train` days before it, the last `horizon` days after it.
    Spots between are floored to the day. The array is empty if the history is
    too short.
    """
    lo = F.date_add("_min", min_train)
    hi = F.date_sub("_max", horizon - 1)
    span = F.datediff(hi, lo)
    if folds <= 1:
        spots = F.array(hi)
    else:
        spots = F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.lit(folds - 1)),
            lambda i: F.date_add(lo, F.floor(span * i / F.lit(folds - 1)).cast("int"))))
    ends = series.agg(F.min("date").alias("_min"), F.max("date").alias("_max"))
    return ends.select(F.when(span >= 0, spots).otherwise(
        F.array().cast("array<date>")).alias("origins"))


def _in_folds(rows: DataFrame, origins: DataFrame, where) -> DataFrame:
    """Each row once for every origin `o` with where(o): the origins are a small
    constant array, so a fold is a column and no join is needed."""
    return (attach(rows, origins, "origins")
            .withColumn(FOLD, F.explode(F.filter("origins", where))).drop("origins"))


def training_folds(rows: DataFrame, origins: DataFrame, min_days: int = P.MIN_FOLD_DAYS
                   ) -> DataFrame:
    """Each row once for every origin after its date.

    Only reduced rows come here, never raw facts. Folds with fewer than `min_days`
    days of history are left out.
    """
    before = lambda o: o > F.col("date")
    out = _in_folds(rows, origins, before)
    days = (_in_folds(rows.select("date").distinct(), origins, before)
            .groupBy(FOLD).agg(F.count("*").alias("_d")).filter(F.col("_d") >= min_days))
    return out.join(days.select(FOLD), FOLD, "left_semi")


def fold_sums(rows: DataFrame, origins: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """origin_date, keys and sums over all rows before each origin.

    Rows are summed by the stretch between two origins they fall in; only these
    sums are repeated for the origins behind them.
    """
    ordered = origins.select(F.array_sort("origins").alias("origins"))
    placed = attach(rows, ordered, "origins").withColumn(
        "_stretch", F.size(F.filter("origins", lambda o: o <= F.col("date"))))
    part = placed.groupBy(*keys, "_stretch").agg(*[F.sum(c).alias(c) for c in sums])
    each = attach(part, ordered, "origins").withColumn(FOLD, F.explode(F.slice(
        "origins", F.col("_stretch") + 1, F.size("origins"))))
    return each.groupBy(FOLD, *keys).agg(*[F.sum(c).alias(c) for c in sums])


def actuals(series: DataFrame, origins: DataFrame) -> DataFrame:
    """origin_date, entity, forecast_period, revenue, roas of what really came.

    The three horizons are conditional sums; a horizon without a row is absent.
    """
    rows = _in_folds(series, origins, lambda o: (o <= F.col("date")) & (
        F.col("date") < F.date_add(o, P.MAX_HORIZON))).withColumn("_d", F.datediff("date", FOLD))
    aggs = []
    for label, h in P.HORIZONS.items():
        near = F.col("_d") < h
        aggs += [F.count_if(near).alias(f"n_{label}")]
        aggs += [F.sum(F.when(near, F.col(m).cast("decimal(28,6)"))).cast("double")
                 .alias(f"{m}_{label}") for m in ("revenue", "spend")]
    g = rows.groupBy(FOLD, *ENTITY).agg(*aggs)
    per = F.explode(F.array(*[
        F.struct(F.lit(label).alias("forecast_period"), F.col(f"n_{label}").alias("n"),
                 F.col(f"revenue_{label}").alias("revenue"),
                 F.col(f"spend_{label}").alias("spend")) for label in P.HORIZONS]))
    return (g.select(FOLD, *ENTITY, per.alias("h")).filter("h.n > 0")
            .select(FOLD, *ENTITY, "h.forecast_period", F.col("h.revenue").alias("revenue"),
                    safe_ratio("h.revenue", "h.spend").alias("roas")))


def actuals_long(act: DataFrame) -> DataFrame:
    metrics = F.array(F.struct(F.lit("Revenue").alias("metric"), F.col("revenue").alias("actual")),
                      F.struct(F.lit("ROAS").alias("metric"), F.col("roas").alias("actual")))
    return act.select(FOLD, *ENTITY, "forecast_period", F.explode(metrics).alias("m")).select(
        FOLD, *ENTITY, "forecast_period", "m.*")


def score_forecasts(predictions: DataFrame, act: DataFrame) -> DataFrame:
    """Scorecard: one row for each prediction whose actual is known."""
    keys = [FOLD, *ENTITY, "forecast_period", "metric"]
    rows = predictions.join(actuals_long(act), keys)
    return rows.select(
        *keys, F.bround("actual", 4).alias("actual"), "p10", "p50", "p90",
        F.bround(F.abs(F.col("p50") - F.col("actual")), 4).alias("absolute_error"),
        F.bround(ape("actual", "p50"), 4).alias("ape"),
        F.bround(smape("actual", "p50"), 4).alias("smape"),
        ((F.col("p10") <= F.col("actual")) & (F.col("actual") <= F.col("p90")))
        .alias("covered_by_interval"))


def naive_baseline(daily: DataFrame, origins: DataFrame, window: int = P.TRAILING_DAYS
                   ) -> DataFrame:
    """origin_date, revenue and spend of the average day in the trailing calendar window.

    `daily` has one row a day. An origin without rows in its window is absent.
    """
    rows = _in_folds(daily, origins, lambda o: (o > F.col("date")) & (
        F.col("date") >= F.date_sub(o, window)))
    return rows.groupBy(FOLD).agg(*[
        (F.sum(F.col(m).cast("decimal(28,6)")).cast("double") / F.count("*")).alias(f"avg_{m}")
        for m in ("revenue", "spend")])


def naive_forecast(naive: DataFrame) -> DataFrame:
    """origin_date, forecast_period, metric, predicted: the average day held flat."""
    cells = F.array(*[
        F.struct(F.lit(label).alias("forecast_period"), F.lit(metric).alias("metric"),
                 value.alias("predicted"))
        for label, h in P.HORIZONS.items()
        for metric, value in (("Revenue", F.col("avg_revenue") * h),
                              ("ROAS", safe_ratio("avg_revenue", "avg_spend")))])
    return naive.select(FOLD, F.explode(cells).alias("c")).select(FOLD, "c.*")


def score_naive(naive: DataFrame, act: DataFrame) -> DataFrame:
    overall = actuals_long(act.filter(F.col("dimension_type") == P.OVERALL))
    keys = [FOLD, "forecast_period", "metric"]
    return naive_forecast(naive).join(overall.select(*keys, "actual"), keys).select(
        *keys, F.bround("actual", 4).alias("actual"), F.bround("predicted", 4).alias("predicted"),
        F.bround(F.abs(F.col("predicted") - F.col("actual")), 4).alias("absolute_error"),
        F.bround(ape("actual", "predicted"), 4).alias("ape"))


def segment_errors(scorecard: DataFrame) -> DataFrame:
    """Errors by metric, horizon and level."""
    return scorecard.groupBy("metric", "forecast_period", "dimension_type").agg(
        F.count("*").alias("rows"),
        F.bround(F.avg("absolute_error"), 4).alias("mae"),
        F.bround(rmse("absolute_error"), 4).alias("rmse"),
        F.bround(F.avg("ape"), 4).alias("mape"),
        F.bround(F.avg("smape"), 4).alias("smape"),
        F.bround(wape("actual", "p50"), 4).alias("wape"),
        F.bround(F.avg(F.col("covered_by_interval").cast("int")) * 100.0, 4)
        .alias("interval_coverage"))


def headline_errors(scorecard: DataFrame) -> DataFrame:
    """Two rows: the levels above campaigns together, and campaigns."""
    block = F.when(F.col("dimension_type") == P.CAMPAIGN, "campaign_level").otherwise("overall")
    rev, roas = F.col("metric") == "Revenue", F.col("metric") == "ROAS"

    def only(cond: Column, c: str) -> Column:
        return F.when(cond, F.col(c))

    return scorecard.groupBy(block.alias("block")).agg(
        F.count("*").alias("rows_scored"),
        F.bround(safe_ratio(F.sum(F.abs(only(rev, "actual") - only(rev, "p50"))),
                            F.sum(F.abs(only(rev, "actual")))) * 100.0, 4).alias("revenue_wape"),
        F.bround(rmse(only(rev, "absolute_error")), 4).alias("revenue_rmse"),
        F.bround(F.avg(only(rev, "smape")), 4).alias("revenue_smape"),
        F.bround(rmse(only(roas, "absolute_error")), 4).alias("roas_rmse"),
        F.bround(F.avg(only(roas, "smape")), 4).alias("roas_smape"),
        F.bround(F.avg(F.col("covered_by_interval").cast("int")) * 100.0, 4)
        .alias("interval_coverage"))


def compare_to_naive(scorecard: DataFrame, naive_scores: DataFrame) -> DataFrame:
    """Model against baseline at portfolio level; segments without model rows drop out."""
    keys = ["metric", "forecast_period"]

    def errors(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.bround(F.avg("absolute_error"), 4).alias(f"{name}_mae"),
            F.bround(rmse("absolute_error"), 4).alias(f"{name}_rmse"),
            F.bround(F.avg("ape"), 4).alias(f"{name}_mape"))

    model = errors(scorecard.filter(F.col("dimension_type") == P.OVERALL), "ensemble")
    naive = errors(naive_scores, "naive_baseline")
    gain = (F.col("naive_baseline_mape") - F.col("ensemble_mape")) / F.col("naive_baseline_mape")
    return naive.join(model, keys).select(
        *keys, *[f"{n}_{e}" for n in ("ensemble", "naive_baseline") for e in ("mae", "rmse", "mape")],
        (F.col("ensemble_mape") < F.col("naive_baseline_mape")).alias("ensemble_beats_naive_baseline"),
        F.when(F.col("naive_baseline_mape") != 0, F.bround(gain * 100.0, 2))
        .alias("mape_improvement_pct"))


def ranked_segments(segments: DataFrame, n: int = 6, worst: bool = False) -> DataFrame:
    """The n segments with the least (or most) weighted error."""
    err = F.coalesce("wape", "smape")
    return segments.orderBy(err.desc() if worst else err.asc(), "metric", "forecast_period",
                            "dimension_type").limit(n)


def best_per_group(segments: DataFrame, n: int = 6, worst: bool = False) -> DataFrame:
    """One segment for each level and metric, then the n best (worst) of these.

    Segments are a row for each metric, horizon and level, so windows are tiny.
    """
    err = F.when(F.col("metric") == "Revenue", F.coalesce("wape", "smape")).otherwise(F.col("smape"))
    order = F.col("score").desc() if worst else F.col("score").asc()
    w = Window.partitionBy("dimension_type", "metric").orderBy(order, "forecast_period")
    return (segments.withColumn("score", err).withColumn("_r", F.row_number().over(w))
            .filter("_r = 1").drop("_r")
            .orderBy(order, "dimension_type", "metric").limit(n))


def latest_scored(scorecard: DataFrame, n: int = 18) -> DataFrame:
    """The last n scorecard rows in order of origin, horizon, level and metric."""
    return scorecard.orderBy(*[F.col(c).desc() for c in (
        FOLD, "forecast_period", "dimension_type", "metric", "dimension_value")]).limit(n)


def distinct_origins(scorecard: DataFrame) -> DataFrame:
    return scorecard.select(FOLD).distinct()
