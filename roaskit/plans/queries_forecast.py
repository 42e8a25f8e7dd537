"""Queries on forecasting and backtesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.operators import anchor as A
from roaskit.operators import backtest as B
from roaskit.operators import effects as EF
from roaskit.operators import ensemble as EN
from roaskit.operators import entities as E
from roaskit.operators import forecast as FC
from roaskit.plans import documents as DOC
from roaskit.plans import forecasting, scoring
from roaskit.plans import sql as S
from roaskit.plans.backtesting import run_backtest
from roaskit.plans.catalog import query
from roaskit.sources import state
from roaskit.sources.storage import materialize, new_folder
from roaskit.sources.tables import campaign_facts

ENT = "dimension_type:s dimension_value:s"
FOLDS = 3


def series_of(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(E.entity_daily(E.daily_cube(campaign_facts(spark, sf))), "series")


@query("monthly_seasonal_index", f"{ENT} month:i revenue_index:6 spend_index:6",
       ",".join([S.SERIES, S.anchors()]) + """, result AS (
  SELECT * FROM idx WHERE revenue_index IS NOT NULL OR spend_index IS NOT NULL)""")
def _(spark, sf):
    return A.seasonal_index_long(series_of(spark, sf))


@query("recent_anchors", f"{ENT} last_date:d rows_used:i daily_revenue:4 daily_spend:4 "
       "revenue_trend_per_day:5 spend_trend_per_day:5 revenue_deseasonalized:b spend_deseasonalized:b",
       ",".join([S.SERIES, S.anchors()]), "anchors")
def _(spark, sf):
    """Level, seasonal correction and momentum of all entities."""
    return A.recent_anchors(series_of(spark, sf))


# Campaign ids within a channel: many short and spiky series, so that the seasonal
# correction fires, slopes are capped and some entities have too few rows.
FINE = S.FACTS + """,
series AS (
  SELECT 'Overall' AS dimension_type, 'Total Portfolio' AS dimension_value, date,
    CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(spend) AS DOUBLE) AS spend FROM facts GROUP BY date
  UNION ALL SELECT 'Campaign', channel || '/' || campaign_id, date, CAST(sum(revenue) AS DOUBLE),
    CAST(sum(spend) AS DOUBLE) FROM facts GROUP BY channel, campaign_id, date
)"""


def fine_series(spark: SparkSession, sf: str) -> DataFrame:
    facts = campaign_facts(spark, sf).select(
        "date", F.lit("all").alias("channel"), F.lit("all").alias("campaign_type"),
        F.concat("channel", F.lit("/"), "campaign_id").alias("campaign_name"), "revenue", "spend")
    rows = E.entity_daily(facts)                      # a cube of so fine a key would be as large as the facts
    return materialize(rows.filter(F.col("dimension_type").isin(P.OVERALL, P.CAMPAIGN)), "fine")


@query("recent_anchors_fine", "rows_used:i entities:i revenue:2 spend:2 revenue_slope:3 spend_slope:3 "
       "deseasonalized:i", ",".join([FINE, S.anchors()]) + """, result AS (
  SELECT rows_used, count(*) AS entities, sum(daily_revenue) AS revenue, sum(daily_spend) AS spend,
    sum(revenue_trend_per_day) AS revenue_slope, sum(spend_trend_per_day) AS spend_slope,
    count(*) FILTER (revenue_deseasonalized OR spend_deseasonalized) AS deseasonalized
  FROM anchors GROUP BY rows_used)""")
def _(spark, sf):
    return A.recent_anchors(fine_series(spark, sf)).groupBy("rows_used").agg(
        F.count("*").alias("entities"), F.sum("daily_revenue").alias("revenue"),
        F.sum("daily_spend").alias("spend"), F.sum("revenue_trend_per_day").alias("revenue_slope"),
        F.sum("spend_trend_per_day").alias("spend_slope"),
        F.count_if(F.col("revenue_deseasonalized") | F.col("spend_deseasonalized"))
        .alias("deseasonalized"))


@query("fit_entities", f"{ENT} rows:i revenue_mean:4 spend_mean:4 revenue_std:3 spend_std:3",
       S.MODELS, "model")
def _(spark, sf):
    """Calendar-effects model of every entity with its residual spread."""
    return EF.fit_effects(series_of(spark, sf))


@query("entity_effects", f"{ENT} weekday:i revenue_effect:4 spend_effect:4", S.MODELS + """, result AS (
  SELECT w.dimension_type, w.dimension_value, wd AS weekday, rw - revenue_mean AS revenue_effect,
    sw - spend_mean AS spend_effect FROM wdm w JOIN model USING (dimension_type, dimension_value))""")
def _(spark, sf):
    m = EF.fit_effects(series_of(spark, sf))
    day = F.col("weekday")
    return m.withColumn("weekday", F.explode(F.map_keys("revenue_weekday"))).select(
        *E.ENTITY, "weekday",
        (F.element_at("revenue_weekday", day) - F.col("revenue_mean")).alias("revenue_effect"),
        (F.element_at("spend_weekday", day) - F.col("spend_mean")).alias("spend_effect"))


@query("future_calendar", f"{ENT} day:i date:d month:i quarter:i week:i day_of_week:i is_weekend:i "
       "season_encoded:i", S.SERIES + """,
last AS (SELECT dimension_type, dimension_value, max(date) + 1 AS start FROM series GROUP BY ALL),
f AS (SELECT dimension_type, dimension_value, day, CAST(start + CAST(day AS INTEGER) - 1 AS DATE) AS date
  FROM last CROSS JOIN (SELECT range AS day FROM range(1, 91))),
result AS (SELECT *, month(date) AS month, quarter(date) AS quarter, week(date) AS week,
  isodow(date) - 1 AS day_of_week, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
  CASE WHEN month(date) IN (12, 1, 2) THEN 0 WHEN month(date) <= 5 THEN 1
    WHEN month(date) <= 8 THEN 2 ELSE 3 END AS season_encoded FROM f)""")
def _(spark, sf):
    rows = E.entity_daily(E.daily_cube(campaign_facts(spark, sf)))
    starts = rows.groupBy(*E.ENTITY).agg(F.date_add(F.max("date"), 1).alias("start_date"))
    return FC.future_features(starts)


@query("daily_forecast", f"{ENT} day:i date:d revenue:3 spend:3", S.DAILY, "daily")
def _(spark, sf):
    """Damped trend blended with the calendar model, day by day."""
    s = series_of(spark, sf)
    return FC.daily_forecast(EF.fit_effects(s), A.recent_anchors(s), forecasting.next_day(s))


@query("horizon_intervals", f"{ENT} forecast_period:s p10:2 p50:2 p90:2 spend:2", S.OWN, "own")
def _(spark, sf):
    s = series_of(spark, sf)
    return FC.horizon_intervals(FC.daily_forecast(
        EF.fit_effects(s), A.recent_anchors(s), forecasting.next_day(s)))


@query("forecast_entities", f"{ENT} forecast_period:s p10:2 p50:2 p90:2 spend:2", S.FORECAST, "forecast")
def _(spark, sf):
    """All levels, campaigns reconciled with their channel."""
    return forecasting.full_forecast(campaign_facts(spark, sf))[2]


@query("unseen_fallback", f"{ENT} forecast_period:s p10:2 p50:2 p90:2 spend:2", ",".join([
    FINE, S.anchors(), S.effects(), S.daily(S.START), S.intervals()]) + """,
tot AS (SELECT dimension_type, dimension_value, total_revenue AS r FROM model WHERE dimension_type <> 'Overall'),
scales AS (SELECT dimension_type, median(r / t) AS scale FROM tot JOIN (SELECT dimension_type,
  CAST(sum(CAST(r AS DECIMAL(28,6))) AS DOUBLE) AS t FROM tot GROUP BY ALL) USING (dimension_type) GROUP BY dimension_type),
ov AS (SELECT forecast_period, p10 AS o10, p50 AS o50, p90 AS o90, spend AS os FROM own WHERE dimension_type = 'Overall'),
result AS (SELECT dimension_type, dimension_value, forecast_period, greatest(0.0, o50 * scale - (o90 - o10) * scale) AS p10,
  o50 * scale AS p50, greatest(0.0, o50 * scale + (o90 - o10) * scale) AS p90, os * scale AS spend
  FROM own JOIN ov USING (forecast_period) JOIN scales USING (dimension_type) WHERE NOT has_model)""")
def _(spark, sf):
    s = fine_series(spark, sf)
    own = materialize(FC.horizon_intervals(FC.daily_forecast(
        EF.fit_effects(s), A.recent_anchors(s), forecasting.next_day(s))), "own")
    totals = own.filter(F.col("forecast_period") == "30_days").select(
        *E.ENTITY, F.col("total_revenue").alias("revenue"))
    unseen = own.filter(~F.col("has_model")).select(*E.ENTITY).distinct()
    return FC.unseen_forecast(unseen, own.filter(F.col("dimension_type") == P.OVERALL),
                              E.fallback_scale(totals))


PRED_SPEC = f"forecast_period:s {ENT} metric:s p10:2 p50:2 p90:2"


@query("predictions", PRED_SPEC, S.PREDICTIONS, "predictions")
def _(spark, sf):
    """The predictions table, from facts to tidy rows."""
    return forecasting.predictions(campaign_facts(spark, sf))


STATE_CUT = "1997-01-01"


@query("predict_from_state", PRED_SPEC, ",".join([S.SERIES, S.anchors(), f"""
old AS (SELECT * FROM series WHERE date < DATE '{STATE_CUT}'),
oldfacts AS (SELECT * FROM facts WHERE date < DATE '{STATE_CUT}')""", S.effects("old"), S.least_squares("old"),
    S.daily(S.START, portfolio=True), S.intervals(), S.campaign_map("oldfacts"), S.reconciled(), S.predictions()]), "predictions")
def _(spark, sf):
    """State fitted and stored on what came before a day; the forecast of all facts reads it and fits nothing."""
    facts = campaign_facts(spark, sf)
    path = new_folder(spark, "state")
    state.save_state(scoring.fit_state(facts.filter(F.col("date") < F.lit(STATE_CUT).cast("date"))), path)
    return scoring.predict_from_state(spark, facts, path)


@query("refresh_anchors", f"{ENT} last_date:d daily_revenue:4 daily_spend:4", S.FACTS + """,
sel AS (SELECT * FROM facts WHERE date < DATE '2000-01-01' OR channel IN ('ASIA', 'EUROPE'))
, series AS (
  SELECT 'Channel' AS dimension_type, channel AS dimension_value, date, CAST(sum(revenue) AS DOUBLE) AS revenue,
    CAST(sum(spend) AS DOUBLE) AS spend FROM sel GROUP BY channel, date
),""" + S.anchors() + ", result AS (SELECT * FROM anchors)")
def _(spark, sf):
    """Anchors stored up to 2000; then two channels have news, the others keep theirs."""
    rows = materialize(E.at_level(E.entity_daily(E.daily_cube(campaign_facts(spark, sf))), P.CHANNEL),
                       "channels")
    stored = A.recent_anchors(rows.filter(F.col("date") < F.lit("2000-01-01").cast("date")))
    fresh = A.recent_anchors(rows.filter(F.col("dimension_value").isin("ASIA", "EUROPE")))
    return A.refresh_anchors(stored, fresh)


@query("lookup_forecast", "asked:s forecast_period:s revenue_p50:2 roas_p50:2", S.PREDICTIONS + """,
l AS (
  SELECT 'ASIA' AS asked, * FROM predictions WHERE dimension_value = 'ASIA'
  UNION ALL SELECT 'Nowhere', * FROM predictions WHERE dimension_type = 'Overall'
),
result AS (SELECT asked, forecast_period, max(p50) FILTER (metric = 'Revenue') AS revenue_p50,
  max(p50) FILTER (metric = 'ROAS') AS roas_p50 FROM l GROUP BY ALL)""")
def _(spark, sf):
    """A known dimension answers for itself, an unknown one with the portfolio."""
    p = materialize(forecasting.predictions(campaign_facts(spark, sf)), "predictions")
    out = [FC.forecast_document(p, d).select(
        F.lit(d).alias("asked"), "forecast_period", F.col("Revenue_P50").alias("revenue_p50"),
        F.col("ROAS_P50").alias("roas_p50")) for d in ("ASIA", "Nowhere")]
    return out[0].unionByName(out[1])


@query("forecast_confidence", PRED_SPEC + " confidence_pct:i confidence:s", S.PREDICTIONS + """,
c AS (SELECT *, CASE WHEN p50 <= 0 THEN 40 ELSE
  least(greatest(floor(100.0 - (p90 - p10) / p50 * 28.0 + 0.5), 35), 97) END AS confidence_pct FROM predictions),
result AS (SELECT *, CASE WHEN p50 <= 0 THEN 'Low' WHEN confidence_pct >= 80 THEN 'High'
  WHEN confidence_pct >= 60 THEN 'Medium' ELSE 'Low' END AS confidence FROM c)""")
def _(spark, sf):
    return FC.with_confidence(forecasting.predictions(campaign_facts(spark, sf)))


@query("portfolio_model", "rows:i span:i revenue_std:2 spend_trend:2 fitted_revenue:2 fitted_spend:2", S.SERIES + "," + S.least_squares() + """,
result AS (SELECT count(*) AS rows, max(d1 - d0) AS span, max(pstd) AS revenue_std, max(sb[2]) AS spend_trend,
  sum(list_dot_product(x, rb)) / count(*) AS fitted_revenue, sum(list_dot_product(x, sb)) / count(*) AS fitted_spend
  FROM lsrow JOIN lsbeta USING (dimension_type, dimension_value) JOIN lsstd USING (dimension_type, dimension_value))""")
def _(spark, sf):
    """The seasonal member: coefficients of the normal equations, spread, and its values over the days."""
    own = materialize(E.at_level(series_of(spark, sf), P.OVERALL), "portfolio")
    model = EN.fit_portfolio(own, E.ENTITY, P.LINEAR_MEMBERS)
    rows = EN.member_values(model, own, E.ENTITY, P.LINEAR_MEMBERS).join(model.seasonal.drop("revenue_beta"), E.ENTITY)
    return rows.agg(F.count("*").alias("rows"), F.max(F.datediff("last_date", "first_date")).alias("span"), F.max("revenue_std").alias("revenue_std"),
                    F.max(F.get("spend_beta", F.lit(1))).alias("spend_trend"), F.avg("raw").alias("fitted_revenue"),
                    F.avg("m_spend").alias("fitted_spend"))


@query("portfolio_daily", "day:i date:d ensemble:2 revenue:2 spend:2", S.LEVELS + """,
result AS (SELECT day, date, pr AS ensemble, revenue, spend FROM daily JOIN lsday USING (dimension_type, dimension_value, day))""")
def _(spark, sf):
    """The portfolio day by day: the member alone, and blended with the anchor."""
    return forecasting.overall_daily(campaign_facts(spark, sf))[0]


# Backtest.

@query("make_origins", "origin_date:d", S.SERIES + "," + S.origins(8), "orig")
def _(spark, sf):
    rows = E.daily_cube(campaign_facts(spark, sf)).select("date")
    return B.make_origins(rows, 8).select(F.explode("origins").alias("origin_date"))


def fold_series(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = series_of(spark, sf)
    return s, materialize(B.make_origins(s, FOLDS), "origins")


@query("training_folds", "origin_date:d dimension_type:s rows:i revenue:3", S.SERIES + "," + S.origins(FOLDS) + """,
result AS (SELECT origin_date, dimension_type, count(*) AS rows, sum(revenue) AS revenue
  FROM series JOIN orig ON date < origin_date GROUP BY ALL)""")
def _(spark, sf):
    return B.training_folds(*fold_series(spark, sf)).groupBy("origin_date", "dimension_type").agg(
        F.count("*").alias("rows"), F.sum("revenue").alias("revenue"))


@query("actuals_by_dimension", f"origin_date:d {ENT} forecast_period:s metric:s actual:4",
       ",".join([S.SERIES, S.origins(FOLDS), S.fold_actuals()]), "actl")
def _(spark, sf):
    return B.actuals_long(B.actuals(*fold_series(spark, sf)))


BT = S.backtest(FOLDS)


def bt(spark: SparkSession, sf: str):
    return run_backtest(campaign_facts(spark, sf), FOLDS)


def _naive(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s, origins = fold_series(spark, sf)
    return B.naive_baseline(E.at_level(s, P.OVERALL), origins), B.actuals(s, origins)


@query("naive_baseline", "origin_date:d forecast_period:s metric:s predicted:4", BT, "npred")
def _(spark, sf):
    return B.naive_forecast(_naive(spark, sf)[0])


@query("score_naive", "origin_date:d forecast_period:s metric:s actual:4 predicted:4 absolute_error:4 ape:4",
       BT, "naive_scores")
def _(spark, sf):
    return B.score_naive(*_naive(spark, sf))


SCORE_SPEC = (f"origin_date:d {ENT} forecast_period:s metric:s actual:4 p10:2 p50:2 p90:2 "
              "absolute_error:4 ape:4 smape:4 covered_by_interval:b")


@query("run_backtest", SCORE_SPEC, BT, "scorecard")
def _(spark, sf):
    """Three folds trained, forecast and scored in one job."""
    return bt(spark, sf).scorecard


@query("segment_errors", "metric:s forecast_period:s dimension_type:s rows:i mae:4 rmse:4 mape:4 smape:4 "
       "wape:4 interval_coverage:4", BT, "segments")
def _(spark, sf):
    return B.segment_errors(bt(spark, sf).scorecard)


@query("headline_errors", "block:s rows_scored:i revenue_wape:4 revenue_rmse:4 revenue_smape:4 roas_rmse:4 "
       "roas_smape:4 interval_coverage:4", BT + """, result AS (
  SELECT CASE WHEN dimension_type = 'Campaign' THEN 'campaign_level' ELSE 'overall' END AS block,
    count(*) AS rows_scored,
    sum(abs(actual - p50)) FILTER (metric = 'Revenue') / sum(abs(actual)) FILTER (metric = 'Revenue') * 100.0 AS revenue_wape,
    sqrt(avg(absolute_error * absolute_error) FILTER (metric = 'Revenue')) AS revenue_rmse,
    avg(smape) FILTER (metric = 'Revenue') AS revenue_smape,
    sqrt(avg(absolute_error * absolute_error) FILTER (metric = 'ROAS')) AS roas_rmse,
    avg(smape) FILTER (metric = 'ROAS') AS roas_smape,
    avg(CAST(covered_by_interval AS INTEGER)) * 100.0 AS interval_coverage
  FROM scorecard GROUP BY ALL)""")
def _(spark, sf):
    return B.headline_errors(bt(spark, sf).scorecard)


@query("compare_to_naive", "metric:s forecast_period:s ensemble_mae:4 ensemble_rmse:4 ensemble_mape:4 "
       "naive_baseline_mae:4 naive_baseline_rmse:4 naive_baseline_mape:4 ensemble_beats_naive_baseline:b "
       "mape_improvement_pct:2", BT, "comparison")
def _(spark, sf):
    r = bt(spark, sf)
    return B.compare_to_naive(r.scorecard, r.naive)


@query("backtest_document", "section:s place:i metric:s forecast_period:s dimension_type:s mae:4 mape:4 folds:i rows_scored:i", BT + """,
n AS (SELECT count(DISTINCT origin_date) AS folds, count(*) FILTER (dimension_type <> 'Campaign') AS rows_scored FROM scorecard),
result AS (SELECT 'segment' AS section, row_number() OVER (ORDER BY metric, forecast_period, dimension_type) - 1 AS place, metric,
    forecast_period, dimension_type, mae, mape, folds, rows_scored FROM segments CROSS JOIN n
  UNION ALL SELECT 'baseline', row_number() OVER (ORDER BY metric, forecast_period) - 1, metric, forecast_period, 'Overall',
    ensemble_mae, ensemble_mape, folds, rows_scored FROM comparison CROSS JOIN n)""")
def _(spark, sf):
    """The backtest's document written, read back by its schema and unfolded."""
    path = f"{new_folder(spark, 'documents')}/backtest.json"
    state.write_document(DOC.backtest_document(bt(spark, sf)), path)
    return DOC.backtest_rows(state.read_document(spark, path, DOC.BACKTEST_SCHEMA))


SEG = "metric:s forecast_period:s dimension_type:s wape:4"


@query("strongest_segments", SEG, BT + """, result AS (SELECT * FROM segments
  ORDER BY round_even(wape, 4), metric, forecast_period, dimension_type LIMIT 6)""")
def _(spark, sf):
    return B.ranked_segments(B.segment_errors(bt(spark, sf).scorecard))


@query("watchlist_segments", SEG, BT + """, result AS (SELECT * FROM segments
  ORDER BY round_even(wape, 4) DESC, metric, forecast_period, dimension_type LIMIT 6)""")
def _(spark, sf):
    return B.ranked_segments(B.segment_errors(bt(spark, sf).scorecard), worst=True)


@query("best_per_group", SEG + " score:4", BT + """,
g AS (SELECT *, round_even(CASE WHEN metric = 'Revenue' THEN wape ELSE smape END, 4) AS score FROM segments),
result AS (SELECT * FROM (SELECT * FROM g QUALIFY row_number() OVER (
  PARTITION BY dimension_type, metric ORDER BY score, forecast_period) = 1)
  ORDER BY score, dimension_type, metric LIMIT 6)""")
def _(spark, sf):
    return B.best_per_group(B.segment_errors(bt(spark, sf).scorecard))


@query("latest_scored", f"origin_date:d {ENT} forecast_period:s metric:s p50:2", BT + """,
result AS (SELECT * FROM scorecard ORDER BY origin_date DESC, forecast_period DESC, dimension_type DESC,
  metric DESC, dimension_value DESC LIMIT 18)""")
def _(spark, sf):
    return B.latest_scored(bt(spark, sf).scorecard)


@query("distinct_origins", "origin_date:d", BT + ", result AS (SELECT DISTINCT origin_date FROM scorecard)")
def _(spark, sf):
    return B.distinct_origins(bt(spark, sf).scorecard)


# The tree members: no SQL can grow them, the tests grow exact greedy trees beside them.

EVERY = tuple(P.ENSEMBLE_WEIGHTS)


@query("overall_ensemble")
def _(spark, sf):
    """Portfolio forecast of all four members blended with the anchor."""
    return FC.predictions_long(forecasting.overall_forecast(campaign_facts(spark, sf), EVERY)[0])


@query("ensemble_backtest")
def _(spark, sf):
    """The backtest with all four members fitted anew in every fold."""
    return run_backtest(campaign_facts(spark, sf), FOLDS, members=EVERY).scorecard


TRAJECTORY = """,
result AS (SELECT day, round_even(greatest(0.0, pr - 1.28 * pstd * pow(day, 0.75)), 2) AS p10, round_even(pr, 2) AS p50,
  round_even(pr + 1.28 * pstd * pow(day, 0.75), 2) AS p90 FROM lsday)"""


@query("daily_trajectory", "day:i p10:2 p50:2 p90:2", S.LEVELS + TRAJECTORY)
def _(spark, sf):
    """Day by day, the seasonal member without the anchor."""
    return FC.daily_trajectory(forecasting.overall_daily(campaign_facts(spark, sf))[0], F.col("std_daily"))


@query("ensemble_trajectory")
def _(spark, sf):
    """Day by day, all members without the anchor."""
    return FC.daily_trajectory(forecasting.overall_daily(campaign_facts(spark, sf), EVERY)[0], F.col("std_daily"))
