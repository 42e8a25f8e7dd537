"""Calendar-effects model of every series, out of sums alone.

fitted(day) = weekday mean + month mean - grand mean. It plays the learner that is
blended into the anchor, and its residual spread sets the width of the interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.keyed import map_by_key, seen_keys, values_by_key
from roaskit.operators.entities import ENTITY, together

METRICS = ("revenue", "spend")


def fit_effects(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, rows, and for each metric: grand mean, weekday map, month map, residual std.

    The rows of a series are brought together once and reduced to a row for each weekday
    and month; everything else is computed from these at most 84 rows a series, where they are. The residual spread is
    the population one and comes from the cells' own variances, so no second pass
    over the series is needed. `has_model` is false for series of five rows or less:
    they are forecast from the portfolio instead. `total_revenue` is kept for that.
    """
    keys = list(keys or ENTITY)
    cells = together(series, keys).groupBy(*keys, F.weekday("date").alias("wd"), F.month("date").alias("mo")).agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(m).cast("decimal(28,6)")).alias(f"{m}_s") for m in METRICS],
        *[F.var_pop(m).alias(f"{m}_v") for m in METRICS])
    every = Window.partitionBy(*keys)
    by_wd, by_mo = Window.partitionBy(*keys, "wd"), Window.partitionBy(*keys, "mo")
    mean = {}
    for m in METRICS:
        for tag, w in (("g", every), ("w", by_wd), ("m", by_mo)):
            mean[f"{m}_{tag}"] = (F.sum(f"{m}_s").over(w).cast("double") / F.sum("n").over(w))
    cells = cells.withColumns(mean)
    dev = {}
    for m in METRICS:
        fitted = F.col(f"{m}_w") + F.col(f"{m}_m") - F.col(f"{m}_g")
        gap = F.col(f"{m}_s").cast("double") / F.col("n") - fitted
        dev[f"{m}_gap"] = F.col("n") * gap
        dev[f"{m}_ss"] = F.col("n") * (F.col(f"{m}_v") + gap * gap)
    cells = cells.withColumns(dev)
    aggs = [F.sum("n").alias("rows"), F.sum("revenue_s").cast("double").alias("total_revenue")]
    values, maps = [], {}
    for m in METRICS:
        aggs += [
            F.max(f"{m}_g").alias(f"{m}_mean"),
            F.sqrt(F.greatest(F.lit(0.0), F.sum(f"{m}_ss") / F.sum("n")
                              - F.pow(F.sum(f"{m}_gap") / F.sum("n"), F.lit(2.0))))
            .alias(f"{m}_std"),
        ]
        for name, key, mean, among in (("weekday", "wd", f"{m}_w", range(7)), ("month", "mo", f"{m}_m", range(1, 13))):
            values += values_by_key(key, mean, among)
            maps[f"{m}_{name}"] = map_by_key(mean, among, F.col(f"_{key}_seen"))
    seen = [seen_keys(k).alias(f"_{k}_seen") for k in ("wd", "mo")]
    fitted = cells.groupBy(*keys).agg(*aggs, *seen, *values).withColumns(maps)
    return fitted.select(
        *keys, "rows", "total_revenue",
        *[f"{m}_{x}" for m in METRICS for x in ("mean", "weekday", "month", "std")],
        (F.col("rows") >= P.MIN_MODEL_ROWS).alias("has_model"))


def fitted_value(metric: str, date: Column | str = "date") -> Column:
    """The model's value on a date; a weekday or month never seen counts as average."""
    d = F.col(date) if isinstance(date, str) else date
    grand = F.col(f"{metric}_mean")
    wd = F.coalesce(F.element_at(f"{metric}_weekday", F.weekday(d)), grand)
    mo = F.coalesce(F.element_at(f"{metric}_month", F.month(d)), grand)
    return wd + mo - grand
