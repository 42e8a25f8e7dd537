"""Business scenarios on the portfolio forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.scalars import clamp


def revenue_volatility(std: Column, base: Column, days: int = 30) -> Column:
    """Spread of a horizon's revenue as a share of it, kept within 3..60 %; 15 % unknown."""
    share = std * F.pow(F.lit(float(days)), F.lit(P.HORIZON_POWER)) / base
    return F.coalesce(F.when(base > 0, clamp(share, 0.03, 0.60)), F.lit(0.15))


def scenario_forecasts(base: DataFrame, volatility: Column) -> DataFrame:
    """Seven scenarios for each base row (forecast_period, revenue, roas, spend).

    The scenario table is a constant array unfolded beside each horizon.
    """
    names = ("id", "name", "tag", "cpc_change", "conv_rate_change", "revenue_multiplier",
             "roas_multiplier")
    cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)])
                      for s in P.SCENARIOS])
    rows = base.withColumns({"_vol": volatility, "s": F.explode(cells)})
    d = P.SCENARIO_DEFAULTS
    rev = F.coalesce("revenue", F.lit(d["revenue"])) * F.col("s.revenue_multiplier")
    roas = F.coalesce("roas", F.lit(d["roas"])) * F.col("s.roas_multiplier")
    spend = F.coalesce("spend", F.lit(d["spend"])) * (
        F.col("s.revenue_multiplier") / F.col("s.roas_multiplier"))
    band = clamp(F.col("_vol") * (1.0 + 2.0 * F.abs(F.col("s.revenue_multiplier") - 1.0)),
                 0.06, 0.45)
    return rows.select(
        *[F.col(f"s.{n}").alias(n) for n in names], "forecast_period",
        (rev * (1.0 - band)).alias("Revenue_P10"), rev.alias("Revenue_P50"),
        (rev * (1.0 + band)).alias("Revenue_P90"), (roas * (1.0 - band)).alias("ROAS_P10"),
        roas.alias("ROAS_P50"), (roas * (1.0 + band)).alias("ROAS_P90"),
        spend.alias("Spend_Expected"))
