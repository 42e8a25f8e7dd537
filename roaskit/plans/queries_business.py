"""Queries on budget, risk, scenarios, drivers, insights, history and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.attach import attach, scalar_of
from roaskit.operators import backtest as B
from roaskit.operators import budget as BU
from roaskit.operators import drivers as D
from roaskit.operators import effects as EF
from roaskit.operators import entities as E
from roaskit.operators import insights as IN
from roaskit.operators import risk as R
from roaskit.operators import scenarios as SC
from roaskit.operators.forecast import predictions_long
from roaskit.operators.ingest import quality_score
from roaskit.operators.ordered import running_totals
from roaskit.plans import documents as DOC
from roaskit.plans import forecasting
from roaskit.plans import sql as S
from roaskit.plans.backtesting import run_backtest
from roaskit.plans.catalog import query
from roaskit.plans.queries_ingest import stored_ledger
from roaskit.sources import state
from roaskit.sources.storage import materialize, new_folder
from roaskit.sources.tables import campaign_facts, table
from roaskit.streaming import ingest as ST

BUDGET, TARGET = 1_000_000.0, 4.5


def cube_of(spark: SparkSession, sf: str) -> DataFrame:
    """The daily cube, for queries that read it once."""
    return E.daily_cube(campaign_facts(spark, sf))


def channel_days(spark: SparkSession, sf: str) -> DataFrame:
    """Facts by date and channel, written once: enough for everything on channels."""
    return days_of(campaign_facts(spark, sf))


def days_of(rows: DataFrame) -> DataFrame:
    """Facts, or the cube made from them, by date and channel, written once."""
    return materialize(rows.groupBy("date", "channel").agg(*[F.sum(m).alias(m) for m in E.MEASURES]), "channeldays")


def measured_quality(spark: SparkSession, sf: str) -> Column:
    """The score of the exports' stored audit, as a constant."""
    return scalar_of(quality_score(stored_ledger(spark, sf)), "quality_score")["quality_score"]


# Budget.

@query("monthly_channel", "channel:s month:d spend:4 revenue:4", S.CURVES + """, result AS (
  SELECT * FROM months WHERE spend > 0 AND revenue > 0)""")
def _(spark, sf):
    return BU.monthly_channel(cube_of(spark, sf))


@query("fit_response_curve", "channel:s alpha:6 beta:2 base_roas:6 fit_cv:8", S.CURVES, "curves")
def _(spark, sf):
    return BU.fit_response_curves(channel_days(spark, sf))


@query("run_rate_spend", "channel:s spend:4", S.CURVES, "rates")
def _(spark, sf):
    return BU.run_rate_spend(channel_days(spark, sf))


@query("simulate_budget", "channel:s spend:4 revenue:4 roas:6 revenue_change_pct:6", S.CURVES + """,
sim AS (
  SELECT channel, greatest(100.0, r.spend * (1 + CASE channel WHEN 'ASIA' THEN 20 WHEN 'EUROPE' THEN -35 ELSE 0 END / 100.0)) AS new,
    alpha, beta, alpha * pow(r.spend, beta) AS was FROM rates r JOIN curves USING (channel)
),
result AS (
  SELECT channel, new AS spend, alpha * pow(new, beta) AS revenue, alpha * pow(new, beta) / new AS roas,
    (alpha * pow(new, beta) - was) / (was + 1e-5) * 100.0 AS revenue_change_pct FROM sim
  UNION ALL SELECT NULL, sum(new), sum(alpha * pow(new, beta)), sum(alpha * pow(new, beta)) / (sum(new) + 1e-5), NULL FROM sim
)""")
def _(spark, sf):
    days = channel_days(spark, sf)
    return BU.simulate_budget(BU.run_rate_spend(days), BU.fit_response_curves(days),
                              {"ASIA": 20.0, "EUROPE": -35.0})


ALLOC = S.allocation(BUDGET, TARGET)


def curves_of(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(BU.fit_response_curves(channel_days(spark, sf)), "curves")


@query("allocation_bounds", "channel:s equal_split_share:8 lower:4 upper:4", ALLOC, "bounds")
def _(spark, sf):
    return BU.allocation_bounds(curves_of(spark, sf), BUDGET)


@query("allocation_ladder", "channel:s step:i add_spend:2 add_revenue:4 marginal:8", ALLOC, "ladder")
def _(spark, sf):
    return BU.allocation_ladder(BU.allocation_bounds(curves_of(spark, sf), BUDGET), BUDGET)


@query("cumulative_budget", "channel:s step:i position:i cum_spend:2 cum_revenue:3", ALLOC + """, result AS (
  SELECT channel, step, position, spend - s0 AS cum_spend, revenue - r0 AS cum_revenue FROM walk, base)""")
def _(spark, sf):
    ladder = BU.allocation_ladder(BU.allocation_bounds(curves_of(spark, sf), BUDGET), BUDGET)
    return running_totals(ladder, [-F.round("marginal", 9), F.col("channel"), F.col("step")],
                          {"cum_spend": "add_spend", "cum_revenue": "add_revenue"}, rank="position")


ALLOC_SPEC = "channel:s allocated_spend:2 expected_revenue:3 expected_roas:6 budget_share:6"


@query("allocate_budget", ALLOC_SPEC, ALLOC, "alloc")
def _(spark, sf):
    return BU.allocate_budget(curves_of(spark, sf), BUDGET, TARGET)


@query("allocate_budget_high_target", ALLOC_SPEC, S.allocation(BUDGET, 21.0), "alloc")
def _(spark, sf):
    """A target that binds or cannot be met."""
    return BU.allocate_budget(curves_of(spark, sf), BUDGET, 21.0)


@query("allocate_exact", ALLOC_SPEC, S.allocation_exact(BUDGET, TARGET), "alloc")
def _(spark, sf):
    return BU.allocate_exact(curves_of(spark, sf), BUDGET, TARGET)


@query("allocate_exact_high_target", ALLOC_SPEC, S.allocation_exact(BUDGET, 21.0), "alloc")
def _(spark, sf):
    return BU.allocate_exact(curves_of(spark, sf), BUDGET, 21.0)


LINES = S.CURVES.replace("FROM facts GROUP BY ALL", "FROM lines GROUP BY ALL", 1).replace(
    ",\nmonths AS", ",\nlines AS (SELECT * REPLACE (channel || ' / ' || campaign_name AS channel) FROM facts),\nmonths AS", 1)


@query("allocate_budget_lines", ALLOC_SPEC, S.allocation(BUDGET, TARGET, lower=0.001, curves=LINES), "alloc")
def _(spark, sf):
    """Over 125 lines, a campaign in a channel each, with a lower bound that leaves room for all."""
    days = materialize(campaign_facts(spark, sf).groupBy("date", F.concat_ws(" / ", "channel", "campaign_name").alias("channel"))
                       .agg(F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue")), "linedays")
    curves = materialize(BU.fit_response_curves(days), "curves")
    return BU.allocate_budget(curves, BUDGET, TARGET, lower_share=0.001)


@query("allocation_band", "recommended_total_spend:2 expected_total_revenue:3 expected_total_roas:6 "
       "revenue_p10:3 revenue_p50:3 revenue_p90:3 roas_p10:6 roas_p90:6 target_achievable:b", ALLOC + """,
t AS (SELECT sum(allocated_spend) AS s, sum(expected_revenue) AS r,
  least(greatest(sqrt(sum(pow(expected_revenue * fit_cv, 2))) / sum(expected_revenue), 0.04), 0.30) * 1.28 AS b FROM alloc),
result AS (SELECT s AS recommended_total_spend, r AS expected_total_revenue, r / s AS expected_total_roas,
  r * (1 - b) AS revenue_p10, r AS revenue_p50, r * (1 + b) AS revenue_p90, r / s * (1 - b) AS roas_p10,
  r / s * (1 + b) AS roas_p90, r / s >= 4.5 AS target_achievable FROM t)""")
def _(spark, sf):
    return BU.allocation_total(BU.allocate_budget(curves_of(spark, sf), BUDGET, TARGET), BUDGET, TARGET)


@query("feasibility_note", "target_achievable:b target_achievement_note:s", S.allocation(BUDGET, 500.0) + """,
t AS (SELECT sum(expected_revenue) / sum(allocated_spend) AS roas FROM alloc),
result AS (SELECT roas >= 500 AS target_achievable, printf('Target ROAS 500.0x is out of reach within $1,000,000: '
  || 'the best found is %.2fx. Lower the target or the budget.', roas) AS target_achievement_note FROM t)""")
def _(spark, sf):
    return BU.allocation_total(BU.allocate_budget(curves_of(spark, sf), BUDGET, 500.0), BUDGET, 500.0)


@query("optimized_total_row", "channel:s allocated_spend:2 expected_revenue:3 expected_roas:6 budget_share:4",
       ALLOC + """, result AS (
  SELECT channel, allocated_spend, expected_revenue, expected_roas, budget_share FROM alloc UNION ALL
  SELECT NULL, sum(allocated_spend), sum(expected_revenue), sum(expected_revenue) / sum(allocated_spend),
    sum(budget_share) FROM alloc)""")
def _(spark, sf):
    return BU.allocation_report(BU.allocate_budget(curves_of(spark, sf), BUDGET, TARGET))


@query("marginal_roas", "channel:s roas:6 marginal_roas:6 extra_spend:4 extra_revenue:4", S.CHANNELS + """, result AS (
  SELECT channel, roas, roas * 0.80 AS marginal_roas, spend * 0.20 AS extra_spend,
    spend * 0.20 * roas * 0.80 AS extra_revenue FROM channels)""")
def _(spark, sf):
    return BU.marginal_roas(cube_of(spark, sf))


# Risk.

def weekly_of(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(R.weekly_channel(campaign_facts(spark, sf)), "weekly")


@query("weekly_series", "week:d revenue:4 spend:4 roas:6", S.RISK, "wtot")
def _(spark, sf):
    return R.weekly_series(R.weekly_channel(campaign_facts(spark, sf)))


@query("weekly_cv", "revenue_cv:8 roas_cv:8 weeks:i", S.RISK, "wcv")
def _(spark, sf):
    return R.weekly_variation(weekly_of(spark, sf))


@query("channel_hhi", "hhi:8 top_channel:s top_share_pct:1", S.RISK, "conc")
def _(spark, sf):
    return R.concentration(weekly_of(spark, sf))


@query("most_volatile_channel", "volatile_channel:s", S.RISK + """, result AS (
  SELECT channel AS volatile_channel FROM wch WHERE weeks >= 2 ORDER BY roas_cv DESC, channel LIMIT 1)""")
def _(spark, sf):
    return R.most_volatile_channel(weekly_of(spark, sf))


@query("risk_score", "risk_score:1 risk_classification:s revenue_volatility:4 channel_dependency:4 "
       "roas_instability:4 data_quality:4 top_channel:s volatile_channel:s", S.RISK, "risk")
def _(spark, sf):
    return R.risk_profile(weekly_of(spark, sf), measured_quality(spark, sf))


@query("risk_factor_table", "name:s score:1 status:s impact:s", S.RISK + """, result AS (
  SELECT 'Revenue Volatility' AS name, round_even(revenue_volatility, 1) AS score,
    CASE WHEN revenue_volatility < 40 THEN 'Healthy' ELSE 'Monitor' END AS status, 'High' AS impact FROM risk
  UNION ALL SELECT 'Channel Dependency', round_even(channel_dependency, 1),
    CASE WHEN channel_dependency > 50 THEN 'Concentrated' ELSE 'Diversified' END, 'Medium' FROM risk
  UNION ALL SELECT 'ROAS Instability', round_even(roas_instability, 1),
    CASE WHEN roas_instability > 50 THEN 'Volatile' ELSE 'Stable' END, 'High' FROM risk
  UNION ALL SELECT 'Data Quality Audit', round_even(data_quality, 1),
    CASE WHEN data_quality < 10 THEN 'Excellent' ELSE 'Action Required' END, 'Low' FROM risk)""")
def _(spark, sf):
    return R.risk_factors(R.risk_profile(weekly_of(spark, sf), measured_quality(spark, sf)))


# Scenarios and simulation.

def overall_base(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(portfolio forecast rows with roas, one row with its daily spread and 30-day revenue)"""
    fc, spread = forecasting.overall_forecast(campaign_facts(spark, sf))
    base = materialize(fc.select("forecast_period", F.col("p50").alias("revenue"), (F.col("p50") / F.col("spend")).alias("roas"),
                                 "spend"), "overall")
    spread = spread.select("revenue_std")
    first = base.filter(F.col("forecast_period") == "30_days").agg(
        F.max("revenue").alias("revenue_30d"), F.max("spend").alias("spend_30d"))
    return base, materialize(attach(first, spread), "spread")


VOL = S.LEVELS + """,
vol AS (SELECT coalesce(least(greatest((SELECT pstd FROM lsstd)
  * pow(30, 0.75) / p50, 0.03), 0.60), 0.15) AS vol FROM own
  WHERE dimension_type = 'Overall' AND forecast_period = '30_days')"""


@query("revenue_volatility", "vol:8", VOL, "vol")
def _(spark, sf):
    _, spread = overall_base(spark, sf)
    return spread.select(SC.revenue_volatility(F.col("revenue_std"), F.col("revenue_30d")).alias("vol"))


@query("scenarios", "id:s tag:s forecast_period:s Revenue_P10:3 Revenue_P50:3 Revenue_P90:3 ROAS_P10:6 "
       "ROAS_P50:6 ROAS_P90:6 Spend_Expected:3", VOL + """,
sc AS (SELECT * FROM (VALUES ('expected', 'Baseline', 1.0, 1.0), ('conservative', 'Low Risk', 0.88, 0.85),
  ('aggressive', 'High Growth', 1.25, 1.08), ('recession', 'Warning', 0.75, 0.80),
  ('holiday', 'Seasonal', 1.45, 1.16), ('black_friday', 'Peak Event', 1.85, 1.25),
  ('high_competition', 'Threat', 0.90, 0.72)) v(id, tag, m, q)),
b AS (SELECT id, tag, forecast_period, p50 * CAST(m AS DOUBLE) AS rev, p50 / spend * CAST(q AS DOUBLE) AS roas,
    spend * (CAST(m AS DOUBLE) / CAST(q AS DOUBLE)) AS sp,
    least(greatest(vol * (1 + 2 * abs(CAST(m AS DOUBLE) - 1)), 0.06), 0.45) AS band
  FROM own CROSS JOIN sc CROSS JOIN vol WHERE dimension_type = 'Overall'),
result AS (SELECT id, tag, forecast_period, rev * (1 - band) AS Revenue_P10, rev AS Revenue_P50,
  rev * (1 + band) AS Revenue_P90, roas * (1 - band) AS ROAS_P10, roas AS ROAS_P50, roas * (1 + band) AS ROAS_P90,
  sp AS Spend_Expected FROM b)""")
def _(spark, sf):
    base, spread = overall_base(spark, sf)
    s = scalar_of(spread, "revenue_std", "revenue_30d")
    return SC.scenario_forecasts(base, SC.revenue_volatility(s["revenue_std"], s["revenue_30d"]))


# Drivers.

MATRIX = S.FACTS + """,
m AS (SELECT date, channel, CAST(sum(spend) AS DOUBLE) AS spend, CAST(sum(revenue) AS DOUBLE) AS revenue,
  sum(clicks) AS clicks, sum(impressions) AS impressions FROM facts GROUP BY ALL),
matrix AS (SELECT *, revenue / (spend + 1e-5) AS roas, spend / (clicks + 1e-5) AS cpc,
  clicks / (impressions + 1e-5) AS ctr, month(date) AS month, isodow(date) - 1 AS day_of_week,
  dense_rank() OVER (ORDER BY channel) AS channel_encoded FROM m)"""


@query("driver_matrix", "date:d channel:s spend:4 revenue:4 clicks:1 impressions:1 roas:6 cpc:6 ctr:6 month:i "
       "day_of_week:i channel_encoded:i", MATRIX, "matrix")
def _(spark, sf):
    return D.driver_matrix(cube_of(spark, sf))


def importance_sql(target: str) -> str:
    """The drivers standardized, and their normal equations solved by elimination without pivots."""
    names = ", ".join(f"('{d}', '{D.DRIVER_LABELS[d]}', {i})" for i, d in enumerate(D.DRIVERS, 1))
    x = ", ".join(f"coalesce(CAST({d} AS DOUBLE), 0)" for d in D.DRIVERS)
    return MATRIX + f""",
drow AS MATERIALIZED (SELECT [{x}] AS x, {target} AS y FROM matrix),
dstat AS (SELECT list(a ORDER BY i) AS a, list(s ORDER BY i) AS s FROM (
  SELECT i, avg(x[i]) AS a, stddev_pop(x[i]) AS s FROM drow, (SELECT range AS i FROM range(1, 9)) GROUP BY i)),
dz AS MATERIALIZED (SELECT list_concat([CASE WHEN s[i] > abs(a[i]) * 1e-9 THEN (x[i] - a[i]) / s[i] ELSE 0.0::DOUBLE END
  FOR i IN range(1, 9)], [y - (SELECT avg(y) FROM drow)]) AS z FROM drow CROSS JOIN dstat),
dcell AS (SELECT i, j, sum(z[i] * z[j]) + CASE WHEN i = j THEN 1e-6 ELSE 0 END AS v FROM dz
  CROSS JOIN (SELECT range AS i FROM range(1, 9)) CROSS JOIN (SELECT range AS j FROM range(1, 10)) GROUP BY i, j),
delim AS (
  SELECT 0 AS step, list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM dcell GROUP BY i)
  UNION ALL
  SELECT step + 1, [CASE WHEN i = step + 1 THEN [m[i][j] / m[i][i] FOR j IN range(1, 10)]
    ELSE [m[i][j] - m[i][step + 1] * m[step + 1][j] / m[step + 1][step + 1] FOR j IN range(1, 10)] END FOR i IN range(1, 9)]
  FROM delim WHERE step < 8),
result AS (SELECT feature, label, abs((SELECT m[i][9] FROM delim WHERE step = 8)) * (SELECT avg(abs(z[i])) FROM dz) AS impact
  FROM (VALUES {names}) f(feature, label, i))"""


@query("driver_importance_revenue", "feature:s label:s impact:4", importance_sql("revenue"))
def _(spark, sf):
    return D.linear_importance(materialize(D.driver_matrix(cube_of(spark, sf)), "drivers"), "revenue")


@query("driver_importance_roas", "feature:s label:s impact:8", importance_sql("least(roas, 20.0)"))
def _(spark, sf):
    return D.linear_importance(materialize(D.driver_matrix(cube_of(spark, sf)), "drivers"), "roas")


@query("channel_importance", "channel:s contribution_share:1 roas_stability:s importance_score:i", S.CHANNELS + """,
result AS (SELECT channel, revenue_share_pct AS contribution_share,
  printf('%s (Historical ROAS: %.1fx)', CASE WHEN roas >= 4 THEN 'High' WHEN roas >= 2.5 THEN 'Medium' ELSE 'Low' END, roas)
    AS roas_stability,
  round_even(revenue / max(revenue) OVER () * 95.0, 0) AS importance_score FROM channels)""")
def _(spark, sf):
    return D.channel_importance(channel_days(spark, sf))


CAMPAIGNS = S.FACTS + """,
camps AS (SELECT channel, campaign_name, CAST(sum(revenue) AS DOUBLE) AS total_historical_revenue,
  CAST(sum(revenue) AS DOUBLE) / (CAST(sum(spend) AS DOUBLE) + 1e-5) AS average_roas,
  CASE WHEN CAST(sum(revenue) AS DOUBLE) / (CAST(sum(spend) AS DOUBLE) + 1e-5) >= 4 THEN 'Primary Bedrock'
    ELSE 'Volume Accelerator' END AS driver_status FROM facts GROUP BY ALL),
top8 AS (SELECT * FROM camps ORDER BY total_historical_revenue DESC, channel, campaign_name LIMIT 8)"""
CAMP_SPEC = "channel:s campaign_name:s total_historical_revenue:4 average_roas:6 driver_status:s"


@query("campaign_importance", CAMP_SPEC, CAMPAIGNS, "top8")
def _(spark, sf):
    return D.campaign_importance(cube_of(spark, sf))


@query("sort_campaigns", "mode:s " + CAMP_SPEC, CAMPAIGNS + """, result AS (
  SELECT 'revenue' AS mode, * FROM (SELECT * FROM top8 ORDER BY total_historical_revenue DESC, channel, campaign_name LIMIT 3)
  UNION ALL SELECT 'best', * FROM (SELECT * FROM top8 ORDER BY average_roas DESC, channel, campaign_name LIMIT 3)
  UNION ALL SELECT 'worst', * FROM (SELECT * FROM top8 ORDER BY average_roas, channel, campaign_name LIMIT 3))""")
def _(spark, sf):
    top = materialize(D.campaign_importance(cube_of(spark, sf)), "top")
    out = [D.sort_campaigns(top, m).withColumn("mode", F.lit(m)) for m in ("revenue", "best", "worst")]
    return out[0].unionByName(out[1]).unionByName(out[2])


# Insights.

CH = S.CHANNELS
CHP = S.CHANNELS + "," + S.PERIODS


@query("channel_efficiency", "channel:s spend:4 revenue:4 roas:6 spend_share:8 revenue_share_pct:1", CH, "channels")
def _(spark, sf):
    return IN.channel_efficiency(channel_days(spark, sf))


@query("campaign_type_totals", "campaign_type:s revenue:4 spend:4 roas:6", S.FACTS + """, result AS (
  SELECT campaign_type, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(spend) AS DOUBLE) AS spend,
    CAST(sum(revenue) AS DOUBLE) / (CAST(sum(spend) AS DOUBLE) + 1e-5) AS roas FROM facts GROUP BY campaign_type)""")
def _(spark, sf):
    return IN.campaign_type_totals(campaign_facts(spark, sf))


@query("leading_channels", "top_channel:s low_channel:s top_roas_channel:s", CH + """, result AS (SELECT
  (SELECT channel FROM channels ORDER BY revenue DESC, channel LIMIT 1) AS top_channel,
  (SELECT channel FROM channels ORDER BY revenue, channel LIMIT 1) AS low_channel,
  (SELECT channel FROM channels ORDER BY roas DESC, channel LIMIT 1) AS top_roas_channel)""")
def _(spark, sf):
    return IN.leaders(IN.channel_efficiency(channel_days(spark, sf)))


@query("channel_shares", "channel:s share:8 revenue_share_pct:1", CH + """, result AS (
  SELECT channel, revenue / sum(revenue) OVER () AS share, revenue_share_pct FROM channels)""")
def _(spark, sf):
    days = channel_days(spark, sf)
    pct = IN.channel_efficiency(days).select("channel", "revenue_share_pct")
    return R.channel_shares(R.weekly_channel(days)).join(pct, "channel")


@query("period_over_period", "revenue_recent:4 revenue_prior:4 spend_recent:4 spend_prior:4 roas_recent:6 "
       "roas_prior:6 revenue_delta_pct:6 roas_delta_pct:6", CHP, "pop")
def _(spark, sf):
    return IN.period_over_period(IN.channel_periods(channel_days(spark, sf)))


@query("channel_trends", "channel:s revenue_recent:4 revenue_prior:4 roas_recent:6 roas_prior:6 cpm_recent:6 "
       "cpm_prior:6 revenue_delta_pct:6 role:s", CHP + """,
tr AS (SELECT *, revenue_recent / (spend_recent + 1e-5) AS roas_recent, revenue_prior / (spend_prior + 1e-5) AS roas_prior,
  CASE WHEN impressions_recent > 0 THEN spend_recent / impressions_recent * 1000 END AS cpm_recent,
  CASE WHEN impressions_prior > 0 THEN spend_prior / impressions_prior * 1000 END AS cpm_prior,
  CASE WHEN revenue_prior > 0 THEN (revenue_recent - revenue_prior) / (revenue_prior + 1e-5) * 100 ELSE 0 END AS revenue_delta_pct
  FROM periods),
dn AS (SELECT channel AS down FROM tr WHERE revenue_prior > 0 ORDER BY revenue_delta_pct, channel LIMIT 1),
st AS (SELECT channel AS firm FROM tr WHERE channel NOT IN (SELECT down FROM dn) ORDER BY roas_recent DESC, channel LIMIT 1),
result AS (SELECT *, CASE WHEN channel IN (SELECT down FROM dn) THEN 'declining'
  WHEN channel IN (SELECT firm FROM st) THEN 'stable' ELSE 'other' END AS role FROM tr)""")
def _(spark, sf):
    return IN.channel_trends(materialize(IN.channel_periods(channel_days(spark, sf)), "periods"))


ANCH = CHP + """,
anch AS (SELECT channel AS efficiency_anchor, roas AS anchor_roas FROM channels ORDER BY roas DESC, channel LIMIT 1),
momd AS (SELECT channel AS momentum_driver FROM periods WHERE channel NOT IN (SELECT efficiency_anchor FROM anch)
  ORDER BY spend_recent / (spend_prior + 1e-5) DESC, channel LIMIT 1),
am AS (SELECT * FROM anch, momd)"""


def channel_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(channel efficiency, channel periods), both a row a channel and written once."""
    days = channel_days(spark, sf)
    return (materialize(IN.channel_efficiency(days), "efficiency"),
            materialize(IN.channel_periods(days), "periods"))


@query("efficiency_anchor", "efficiency_anchor:s anchor_roas:6 momentum_driver:s", ANCH, "am")
def _(spark, sf):
    return IN.anchor_and_momentum(*channel_parts(spark, sf))


@query("growth_opportunities", "channel:s title:s tag:s", CHP + """, result AS (
  SELECT channel, channel || CASE WHEN spend_prior > 0 AND spend_recent > spend_prior * 1.05
      THEN ' Scale Acceleration' ELSE ' Untapped Scale' END AS title,
    CASE WHEN spend_prior > 0 AND spend_recent > spend_prior * 1.05 THEN 'Momentum' ELSE 'Prospecting' END AS tag
  FROM periods)""")
def _(spark, sf):
    return IN.growth_opportunities(IN.channel_periods(channel_days(spark, sf)))


@query("risk_assessment", "position:i title:s severity:s", S.RISK + ",channels AS (SELECT 1)," + S.PERIODS + """,
result AS (
  SELECT 1 AS position, CASE WHEN roas_recent < roas_prior * 0.95 THEN 'ROAS Efficiency Compression'
    ELSE 'Robust Profitability Trends' END AS title,
    CASE WHEN roas_recent < roas_prior * 0.95 THEN 'High' ELSE 'Low' END AS severity FROM pop
  UNION ALL SELECT 2, CASE WHEN risk_score > 50 THEN 'Elevated Portfolio Variance'
    ELSE 'Low Volatility Forecast Confidence' END, CASE WHEN risk_score > 50 THEN 'High' ELSE 'Low' END FROM risk)""")
def _(spark, sf):
    days = channel_days(spark, sf)
    pop = IN.period_over_period(IN.channel_periods(days))
    return IN.risk_assessment(pop, R.risk_profile(materialize(R.weekly_channel(days), "weekly"), measured_quality(spark, sf)))


@query("budget_recommendations", "channel:s roas:6 gap_pct:6 magnitude:i action:s", CH + """,
g AS (SELECT *, (roas - p) / (p + 1e-5) * 100.0 AS gap_pct FROM channels,
  (SELECT sum(revenue) / (sum(spend) + 1e-5) AS p FROM channels)),
h AS (SELECT *, CAST(least(greatest(round_even(abs(gap_pct) * 0.6, 0), 5), 30) AS INTEGER) AS magnitude FROM g),
result AS (SELECT *, CASE WHEN gap_pct > 10 THEN 'Increase Spend (+' || magnitude || '%)'
  WHEN gap_pct < -10 THEN 'Re-allocate (-' || magnitude || '%)' ELSE 'Maintain / Optimize Pacing' END AS action FROM h)""")
def _(spark, sf):
    return IN.budget_recommendations(IN.channel_efficiency(channel_days(spark, sf)))


@query("executive_summary", "executive_summary:s", S.PREDICTIONS + "," + CH.replace(S.FACTS + ",", "") + ","
       + S.PERIODS + ANCH.split(S.PERIODS)[1] + """,
result AS (SELECT printf('$%.2fM of spend brought $%.2fM of revenue (%.2fx ROAS). The next 90 days are expected at $%.2fM. '
  || '%s is the most efficient channel at %.2fx; %s has the strongest spend momentum.', s / 1e6, r / 1e6, r / (s + 1e-5),
  (SELECT p50 FROM predictions WHERE dimension_type = 'Overall' AND forecast_period = '90_days' AND metric = 'Revenue') / 1e6,
  efficiency_anchor, anchor_roas, momentum_driver) AS executive_summary
  FROM (SELECT sum(spend) AS s, sum(revenue) AS r FROM channels), am)""")
def _(spark, sf):
    channels, periods = channel_parts(spark, sf)
    preds = forecasting.predictions(campaign_facts(spark, sf))
    return IN.executive_summary(channels, IN.anchor_and_momentum(channels, periods),
                                IN.overall_90d(preds).select(F.col("revenue_p50").alias("p50")))


@query("budget_shift_note", "channels:i best_channel:s worst_channel:s spend_shares:s roas_gain:6", CH + """,
result AS (SELECT count(*) AS channels, (SELECT channel FROM channels ORDER BY roas DESC, channel LIMIT 1) AS best_channel,
  (SELECT channel FROM channels ORDER BY roas, channel DESC LIMIT 1) AS worst_channel,
  string_agg(printf('%s %.1f%%', channel, spend / (t + 1e-5) * 100), ', ' ORDER BY roas DESC, channel) AS spend_shares,
  (max(roas) - max(p)) * 0.15 AS roas_gain
  FROM channels, (SELECT sum(spend) AS t, sum(revenue) / (sum(spend) + 1e-5) AS p FROM channels))""")
def _(spark, sf):
    return IN.budget_shift_note(IN.channel_efficiency(channel_days(spark, sf)))


@query("last_spend_dormancy", "campaign_type:s last_spend_date:d days_since_last_spend:i status:s", S.FACTS + """,
l AS (SELECT campaign_type, max(date) FILTER (spend > 0) AS last_spend_date FROM facts GROUP BY campaign_type),
result AS (SELECT *, date_diff('day', last_spend_date, (SELECT max(date) FROM facts)) AS days_since_last_spend,
  CASE WHEN last_spend_date IS NULL THEN 'no_spend_on_record'
    WHEN date_diff('day', last_spend_date, (SELECT max(date) FROM facts)) <= 30 THEN 'active' ELSE 'dormant' END AS status
  FROM l)""")
def _(spark, sf):
    return IN.last_spend_by_type(cube_of(spark, sf))


BREAK = S.PREDICTIONS + """,
wide AS (SELECT dimension_type, dimension_value, max(p50) FILTER (metric = 'Revenue') AS revenue_p50,
  max(p50) FILTER (metric = 'ROAS') AS roas, max(p10) FILTER (metric = 'ROAS') AS lo, max(p90) FILTER (metric = 'ROAS') AS hi
  FROM predictions WHERE forecast_period = '90_days' GROUP BY ALL),
breakdown AS (SELECT *, round_even(revenue_p50 / CAST(sum(CAST(revenue_p50 AS DECIMAL(28,2))) OVER (
    PARTITION BY dimension_type) AS DOUBLE) * 100.0, 1) AS share_pct,
  round_even(CASE WHEN roas > 0 THEN (hi - lo) / roas * 100.0 ELSE 0 END, 1) AS interval_width_pct FROM wide)"""


@query("channel_breakdown", "channel:s revenue_p50:2 share_pct:1 roas:2 interval_width_pct:1", BREAK + """,
result AS (SELECT dimension_value AS channel, * FROM breakdown WHERE dimension_type = 'Channel')""")
def _(spark, sf):
    return IN.channel_breakdown(forecasting.predictions(campaign_facts(spark, sf)))


def type_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, breakdown of campaign types with their activity)"""
    cube, _, fc = forecasting.full_forecast(campaign_facts(spark, sf))
    preds = materialize(predictions_long(fc, E.top_campaigns(cube)), "predictions")
    return preds, IN.campaign_type_breakdown(preds, IN.last_spend_by_type(cube))


@query("campaign_type_breakdown", "campaign_type:s revenue_p50:2 share_pct:1 roas:2 status:s days_since_last_spend:i",
       BREAK + """, l AS (SELECT campaign_type, max(date) FILTER (spend > 0) AS d FROM facts GROUP BY campaign_type),
result AS (SELECT dimension_value AS campaign_type, *, date_diff('day', d, (SELECT max(date) FROM facts)) AS days_since_last_spend,
  CASE WHEN date_diff('day', d, (SELECT max(date) FROM facts)) <= 30 THEN 'active' ELSE 'dormant' END AS status
  FROM breakdown b JOIN l ON l.campaign_type = b.dimension_value WHERE dimension_type = 'CampaignType')""")
def _(spark, sf):
    return type_parts(spark, sf)[1]


@query("causal_summary", "causal_summary:s", BREAK + """,
o AS (SELECT revenue_p50, roas FROM wide WHERE dimension_type = 'Overall'),
t AS (SELECT * FROM breakdown WHERE dimension_type = 'Channel' ORDER BY revenue_p50 DESC, dimension_value LIMIT 1),
w AS (SELECT * FROM breakdown WHERE dimension_type = 'Channel' ORDER BY interval_width_pct DESC, dimension_value LIMIT 1),
c AS (SELECT * FROM breakdown WHERE dimension_type = 'CampaignType' ORDER BY revenue_p50 DESC, dimension_value LIMIT 1),
result AS (SELECT printf('$%.1fM is expected over 90 days. %s brings %.1f%% of channel revenue at %.2fx ROAS. '
  || 'The blended %.2fx ROAS hangs most on %s, whose interval spans %.0f%% of its median. %s is the largest type with '
  || '%.1f%% at %.2fx ROAS.', o.revenue_p50 / 1e6, t.dimension_value, t.share_pct, t.roas, o.roas, w.dimension_value,
  w.interval_width_pct, c.dimension_value, c.share_pct, c.roas) AS causal_summary FROM o, t, w, c)""")
def _(spark, sf):
    preds, types = type_parts(spark, sf)
    return IN.causal_summary(IN.channel_breakdown(preds), types,
                             IN.overall_90d(preds).select("revenue_p50", "roas_p50"))


@query("causal_document", "section:s place:i name:s revenue_p50:2 share_pct:1 roas:2 status:s days_since_last_spend:i "
       "total_p50:2 roas_p50:2", BREAK + """,
l AS (SELECT campaign_type, max(date) FILTER (spend > 0) AS d FROM facts GROUP BY campaign_type),
o AS (SELECT revenue_p50 AS total_p50, roas AS roas_p50 FROM wide WHERE dimension_type = 'Overall'),
b AS (SELECT *, dimension_value AS name, row_number() OVER (PARTITION BY dimension_type ORDER BY revenue_p50 DESC, dimension_value) - 1 AS place
  FROM breakdown),
result AS (SELECT 'channel' AS section, *, NULL AS status, NULL AS days_since_last_spend FROM b CROSS JOIN o WHERE dimension_type = 'Channel'
  UNION ALL BY NAME SELECT 'campaign_type' AS section, b.*, o.*,
    CASE WHEN d IS NULL THEN 'no_spend_on_record' WHEN date_diff('day', d, (SELECT max(date) FROM facts)) <= 30 THEN 'active' ELSE 'dormant' END
      AS status, date_diff('day', d, (SELECT max(date) FROM facts)) AS days_since_last_spend
    FROM b CROSS JOIN o LEFT JOIN l ON l.campaign_type = b.dimension_value WHERE dimension_type = 'CampaignType')""")
def _(spark, sf):
    """The document written, read back by its schema and unfolded."""
    preds, types = type_parts(spark, sf)
    path = f"{new_folder(spark, 'documents')}/causal.json"
    state.write_document(DOC.causal_document(IN.channel_breakdown(preds), types, IN.overall_90d(preds)), path)
    return DOC.causal_rows(state.read_document(spark, path, DOC.CAUSAL_SCHEMA))


@query("kpi_overview", "total_spend:4 total_revenue:4 overall_roas:6 roas_label:s quality_score:1 risk_score:1 "
       "risk_classification:s revenue_p10:2 revenue_p50:2 revenue_p90:2 roas_p10:2 roas_p50:2 roas_p90:2",
       S.PREDICTIONS + S.RISK.replace(S.FACTS, "") + """,
k AS (SELECT CAST(sum(spend) AS DOUBLE) AS total_spend, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM facts),
p AS (SELECT max(p10) FILTER (metric = 'Revenue') AS revenue_p10, max(p50) FILTER (metric = 'Revenue') AS revenue_p50,
  max(p90) FILTER (metric = 'Revenue') AS revenue_p90, max(p10) FILTER (metric = 'ROAS') AS roas_p10,
  max(p50) FILTER (metric = 'ROAS') AS roas_p50, max(p90) FILTER (metric = 'ROAS') AS roas_p90
  FROM predictions WHERE dimension_type = 'Overall' AND forecast_period = '90_days'),
result AS (SELECT *, total_revenue / (total_spend + 1e-5) AS overall_roas,
  CASE WHEN total_revenue / (total_spend + 1e-5) < 1 THEN 'Below breakeven'
    WHEN total_revenue / (total_spend + 1e-5) < 3 THEN 'Positive return' ELSE 'Strong return' END AS roas_label
  FROM k, p, risk)""")
def _(spark, sf):
    cube, preds = forecasting.cube_and_predictions(campaign_facts(spark, sf))
    days = days_of(cube)
    return IN.kpi_overview(IN.channel_efficiency(days), IN.overall_90d(preds),
                           R.risk_profile(materialize(R.weekly_channel(days), "weekly"), measured_quality(spark, sf)))


@query("answer_context", "total_spend:2 channel:s roas:2 share_pct:1 forecast_90d_revenue:2 roas_trend_30d_pct:2",
       S.PREDICTIONS + "," + CH.replace(S.FACTS + ",", "") + "," + S.PERIODS + """,
result AS (SELECT sum(spend) OVER () AS total_spend, channel, roas, revenue_share_pct AS share_pct,
  (SELECT p50 FROM predictions WHERE dimension_type = 'Overall' AND forecast_period = '90_days' AND metric = 'Revenue')
    AS forecast_90d_revenue, (SELECT roas_delta_pct FROM pop) AS roas_trend_30d_pct FROM channels)""")
def _(spark, sf):
    """The context as JSON, read back into rows for the comparison."""
    channels, periods = channel_parts(spark, sf)
    preds = forecasting.predictions(campaign_facts(spark, sf))
    doc = IN.answer_context(channels, IN.period_over_period(periods),
                            IN.overall_90d(preds).select("revenue_p50", "roas_p50"))
    schema = ("total_spend double, forecast_90d_revenue double, roas_trend_30d_pct double, "
              "channels map<string, struct<spend double, revenue double, roas double, share_pct double>>")
    return doc.select(F.from_json("context", schema).alias("c")).select(
        "c.total_spend", "c.forecast_90d_revenue", "c.roas_trend_30d_pct",
        F.explode("c.channels").alias("channel", "v")).select("*", "v.roas", "v.share_pct")


@query("report_forecasts", "dimension_value:s horizon:s metric:s p10:s p50:s p90:s", S.PREDICTIONS + """,
r AS (SELECT dimension_value, replace(replace(forecast_period, '_', ' '), 'days', 'Days') AS horizon, metric, p10, p50, p90
  FROM predictions WHERE dimension_type = 'Overall' OR (dimension_type = 'Channel' AND forecast_period = '60_days')),
result AS (SELECT dimension_value, horizon, metric,
  CASE WHEN metric = 'Revenue' THEN format('${:,}', CAST(round_even(p10, 0) AS BIGINT)) ELSE printf('%.2fx', p10) END AS p10,
  CASE WHEN metric = 'Revenue' THEN format('${:,}', CAST(round_even(p50, 0) AS BIGINT)) ELSE printf('%.2fx', p50) END AS p50,
  CASE WHEN metric = 'Revenue' THEN format('${:,}', CAST(round_even(p90, 0) AS BIGINT)) ELSE printf('%.2fx', p90) END AS p90
  FROM r)""")
def _(spark, sf):
    preds = materialize(forecasting.predictions(campaign_facts(spark, sf)), "predictions")
    return IN.report_forecasts(preds).unionByName(IN.report_forecasts(preds, P.CHANNEL, "60_days"))


@query("report_backtest", "forecast_period:s metric:s model_mape:s naive_mape:s coverage:s result:s",
       S.backtest(3) + """, res AS (SELECT c.forecast_period, c.metric, printf('%.1f%%', round_even(ensemble_mape, 4)) AS model_mape,
  printf('%.1f%%', round_even(naive_baseline_mape, 4)) AS naive_mape, printf('%.0f%%', interval_coverage) AS coverage,
  CASE WHEN ensemble_beats_naive_baseline THEN 'beats' ELSE 'trails' END
    || ' (' || CASE WHEN round_even(mape_improvement_pct, 2) >= 0 THEN '+' ELSE '' END
    || printf('%.1f%%', round_even(mape_improvement_pct, 2)) || ')' AS result
  FROM comparison c JOIN segments s ON s.metric = c.metric AND s.forecast_period = c.forecast_period
    AND s.dimension_type = 'Overall')""", "res")
def _(spark, sf):
    r = run_backtest(campaign_facts(spark, sf), 3)
    return IN.report_backtest(B.compare_to_naive(r.scorecard, r.naive), B.segment_errors(r.scorecard))


@query("report_backtest_sentence", "metric:s sentence:s", S.backtest(3) + """,
m AS (SELECT metric, ensemble_beats_naive_baseline AS win, replace(forecast_period, '_days', '-day') || ' ('
    || CASE WHEN round_even(mape_improvement_pct, 2) >= 0 THEN '+' ELSE '' END
    || printf('%.1f%%', round_even(mape_improvement_pct, 2)) || ')' AS mark FROM comparison),
g AS (SELECT metric, string_agg(mark, ', ' ORDER BY mark) FILTER (win) AS b, string_agg(mark, ', ' ORDER BY mark) FILTER (NOT win) AS t,
  FROM m GROUP BY metric),
result AS (SELECT metric, metric || CASE WHEN t IS NULL THEN ' beats the naive baseline at all horizons: ' || b
  WHEN b IS NULL THEN ' trails the naive baseline at all horizons: ' || t
  ELSE ' beats the naive baseline at ' || b || ' and trails it at ' || t END AS sentence FROM g)""")
def _(spark, sf):
    r = run_backtest(campaign_facts(spark, sf), 3)
    return IN.report_backtest_sentence(B.compare_to_naive(r.scorecard, r.naive))


# Run history.

@query("recent_runs", "run_label:s created_at:s k:s v:2", """
r AS (SELECT 'run_' || event_id AS run_label, ts, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, value AS v FROM events),
result AS (SELECT run_label, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS created_at, k, v FROM r
  ORDER BY ts DESC, run_label DESC LIMIT 10)""")
def _(spark, sf):
    """The events read as a history of runs with JSON parameters and summary."""
    runs = table(spark, sf, "events").select(
        F.concat(F.lit("run_"), "event_id").alias("run_label"), F.col("ts").alias("created_at"),
        F.col("props").alias("parameters_json"), F.to_json(F.struct("value")).alias("summary_json"))
    return state.recent_runs(runs, summary="value double").select(
        "run_label", "created_at", F.element_at("parameters", "k").alias("k"),
        F.col("summary.value").alias("v"))


# Streams: the result of the stream must be that of the table.

DAY_SPEC = "date:d channel:s spend:4 revenue:4 clicks:i impressions:i conversions:i"


@query("stream_facts", "event_id:i channel:s spend:4 revenue:4 clicks:i impressions:i conversions:i",
       S.EVENTS, "adrows")
def _(spark, sf):
    return ST.stream_append(ST.stream_facts(ST.stream_events(spark, sf)), "adrows")


@query("stream_daily", DAY_SPEC, S.EVENTS, "eventdays")
def _(spark, sf):
    return ST.stream_daily(ST.stream_events(spark, sf))


@query("stream_dedup", DAY_SPEC.replace("date:d ", ""), S.EVENTS + """, result AS (
  SELECT channel, sum(spend) AS spend, sum(revenue) AS revenue, sum(clicks) AS clicks, sum(impressions) AS impressions,
    sum(conversions) AS conversions FROM adrows GROUP BY channel)""")
def _(spark, sf):
    """Every event sent twice, counted once."""
    rows = ST.stream_facts(ST.stream_events(spark, sf))
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    once = ST.stream_append(ST.stream_dedup(twice), "dedup")
    return once.groupBy("channel").agg(*[F.sum(m).alias(m) for m in ST.MEASURES])


@query("stream_refresh", "dimension_value:s last_date:d daily_revenue:4 daily_spend:4", S.EVENTS + """,
series AS (SELECT 'Channel' AS dimension_type, channel AS dimension_value, date, CAST(revenue AS DOUBLE) AS revenue,
  CAST(spend AS DOUBLE) AS spend FROM eventdays),""" + S.anchors(), "anchors")
def _(spark, sf):
    return ST.stream_refresh(ST.stream_events(spark, sf))
