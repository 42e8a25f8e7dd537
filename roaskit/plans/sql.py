"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

DEC = "DECIMAL(28,6)"

FACTS = """
facts AS (
  SELECT CAST(l_shipdate AS DATE) AS date, r_name AS channel,
         CAST(l_partkey AS VARCHAR) AS campaign_id, p_brand AS campaign_name,
         p_type AS campaign_type,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2))
              * (CAST(l_discount AS DECIMAL(4,2)) + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS spend,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2))
              * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue,
         l_quantity AS clicks, l_quantity * p_size AS impressions,
         CAST(1 AS DOUBLE) AS conversions
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

SERIES = FACTS + """,
series AS (
  SELECT 'Overall' AS dimension_type, 'Total Portfolio' AS dimension_value, date,
         CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(spend) AS DOUBLE) AS spend
  FROM facts GROUP BY date
  UNION ALL SELECT 'Channel', channel, date, CAST(sum(revenue) AS DOUBLE), CAST(sum(spend) AS DOUBLE)
  FROM facts GROUP BY channel, date
  UNION ALL SELECT 'CampaignType', campaign_type, date, CAST(sum(revenue) AS DOUBLE), CAST(sum(spend) AS DOUBLE)
  FROM facts GROUP BY campaign_type, date
  UNION ALL SELECT 'Campaign', campaign_name, date, CAST(sum(revenue) AS DOUBLE), CAST(sum(spend) AS DOUBLE)
  FROM facts GROUP BY campaign_name, date
)"""

CHANNELS = FACTS + """,
channels0 AS (
  SELECT channel, CAST(sum(spend) AS DOUBLE) AS spend, CAST(sum(revenue) AS DOUBLE) AS revenue
  FROM facts GROUP BY channel
),
channels AS (
  SELECT channel, spend, revenue, revenue / (spend + 1e-5) AS roas,
         spend / (sum(spend) OVER () + 1e-5) AS spend_share,
         round_even(revenue / sum(revenue) OVER () * 100.0, 1) AS revenue_share_pct
  FROM channels0
)"""

PERIODS = """
bounds AS (SELECT max(date) AS last FROM facts),
periods AS (
  SELECT channel,
    coalesce(CAST(sum(revenue) FILTER (date >= last - 30) AS DOUBLE), 0) AS revenue_recent,
    coalesce(CAST(sum(revenue) FILTER (date >= last - 60 AND date < last - 30) AS DOUBLE), 0) AS revenue_prior,
    coalesce(CAST(sum(spend) FILTER (date >= last - 30) AS DOUBLE), 0) AS spend_recent,
    coalesce(CAST(sum(spend) FILTER (date >= last - 60 AND date < last - 30) AS DOUBLE), 0) AS spend_prior,
    coalesce(sum(impressions) FILTER (date >= last - 30), 0) AS impressions_recent,
    coalesce(sum(impressions) FILTER (date >= last - 60 AND date < last - 30), 0) AS impressions_prior
  FROM facts, bounds GROUP BY channel
),
pop AS (
  SELECT *, revenue_recent / (spend_recent + 1e-5) AS roas_recent,
         revenue_prior / (spend_prior + 1e-5) AS roas_prior,
         (revenue_recent - revenue_prior) / (revenue_prior + 1e-5) * 100.0 AS revenue_delta_pct,
         (revenue_recent / (spend_recent + 1e-5) - revenue_prior / (spend_prior + 1e-5))
           / (revenue_prior / (spend_prior + 1e-5) + 1e-5) * 100.0 AS roas_delta_pct
  FROM (SELECT sum(revenue_recent) AS revenue_recent, sum(revenue_prior) AS revenue_prior,
               sum(spend_recent) AS spend_recent, sum(spend_prior) AS spend_prior FROM periods)
)"""


def anchors(s: str = "series", fold: str = "") -> str:
    """ym .. anchors: seasonal index and recent anchors of the series table `s`."""
    k = f"{fold}dimension_type, dimension_value"
    return f"""
ym AS (
  SELECT {k}, month(date) AS month, year(date) AS year, sum(CAST(revenue AS {DEC})) AS rs,
         sum(CAST(spend AS {DEC})) AS ss, count(*) AS n
  FROM {s} GROUP BY ALL
),
mm AS (
  SELECT {k}, month,
         CASE WHEN count(*) FILTER (rs > 0) >= 2 THEN
           CAST(sum(rs) FILTER (rs > 0) AS DOUBLE) / sum(n) FILTER (rs > 0) END AS rm,
         CASE WHEN count(*) FILTER (ss > 0) >= 2 THEN
           CAST(sum(ss) FILTER (ss > 0) AS DOUBLE) / sum(n) FILTER (ss > 0) END AS sm
  FROM ym GROUP BY ALL
),
mref AS (SELECT {k}, median(rm) AS rref, median(sm) AS sref FROM mm GROUP BY ALL),
idx AS (
  SELECT {k}, month, CASE WHEN rref > 0 THEN rm / rref END AS revenue_index,
         CASE WHEN sref > 0 THEN sm / sref END AS spend_index
  FROM mm JOIN mref USING ({k})
),
rec AS (
  SELECT {k}, date, revenue, spend,
         row_number() OVER (PARTITION BY {k} ORDER BY date DESC) AS age
  FROM {s} QUALIFY age <= 60
),
recf AS (
  SELECT r.*, coalesce(i.revenue_index, 1.0) AS rf, coalesce(i.spend_index, 1.0) AS sf
  FROM (SELECT *, month(date) AS month FROM rec) r LEFT JOIN idx i USING ({k}, month)
),
ragg AS (
  SELECT {k}, max(date) AS last_date, count(*) AS rows_used,
    avg(rf) FILTER (age <= 30) AS rfac, avg(sf) FILTER (age <= 30) AS sfac,
    avg(revenue) FILTER (age <= 30) AS rnew, avg(revenue) FILTER (age > 30) AS rold,
    avg(spend) FILTER (age <= 30) AS snew, avg(spend) FILTER (age > 30) AS sold,
    avg(revenue / rf) FILTER (age <= 30) AS rnewf, avg(revenue / rf) FILTER (age > 30) AS roldf,
    avg(spend / sf) FILTER (age <= 30) AS snewf, avg(spend / sf) FILTER (age > 30) AS soldf,
    month(max(date) + 1) AS month
  FROM recf GROUP BY {k}
),
rorig AS (
  SELECT a.*, coalesce(i.revenue_index, 1.0) AS ro, coalesce(i.spend_index, 1.0) AS so
  FROM ragg a LEFT JOIN idx i USING ({k}, month)
),
rfire AS (
  SELECT *, rfac > 0 AND (ro / rfac >= 2.0 OR ro / rfac <= 0.5) AS rfires,
            sfac > 0 AND (so / sfac >= 2.0 OR so / sfac <= 0.5) AS sfires
  FROM rorig
),
rlevel AS (
  SELECT *, CASE WHEN rfires THEN rnewf * ro ELSE rnew END AS rlev,
            CASE WHEN sfires THEN snewf * so ELSE snew END AS slev,
            CASE WHEN rfires THEN (rnewf - roldf) / 30.0 * ro ELSE (rnew - rold) / 30.0 END AS rslope,
            CASE WHEN sfires THEN (snewf - soldf) / 30.0 * so ELSE (snew - sold) / 30.0 END AS sslope
  FROM rfire
),
anchors AS (
  SELECT {k}, last_date, rows_used, greatest(rlev, 0.0) AS daily_revenue,
         greatest(slev, 1.0) AS daily_spend,
         CASE WHEN rows_used >= 60 THEN
           least(greatest(rslope, -abs(rlev) * 0.03), abs(rlev) * 0.03) ELSE 0.0 END AS revenue_trend_per_day,
         CASE WHEN rows_used >= 60 THEN
           least(greatest(sslope, -abs(slev) * 0.03), abs(slev) * 0.03) ELSE 0.0 END AS spend_trend_per_day,
         rfires AS revenue_deseasonalized, sfires AS spend_deseasonalized
  FROM rlevel
)"""


def effects(s: str = "series", fold: str = "") -> str:
    """fit, model, wdm, mom: the calendar-effects model of `s`."""
    k = f"{fold}dimension_type, dimension_value"

    def mean(c: str, by: str) -> str:
        w = f"OVER (PARTITION BY {k}{by})"
        return f"CAST(sum(CAST({c} AS {DEC})) {w} AS DOUBLE) / count(*) {w}"

    return f"""
fit AS (
  SELECT {k}, date, revenue, spend, isodow(date) - 1 AS wd, month(date) AS mo,
         {mean('revenue', '')} AS rg, {mean('revenue', ', isodow(date)')} AS rw,
         {mean('revenue', ', month(date)')} AS rmo, {mean('spend', '')} AS sg,
         {mean('spend', ', isodow(date)')} AS sw, {mean('spend', ', month(date)')} AS smo
  FROM {s}
),
model AS (
  SELECT {k}, count(*) AS rows, count(*) > 5 AS has_model,
         CAST(sum(CAST(revenue AS {DEC})) AS DOUBLE) AS total_revenue,
         max(rg) AS revenue_mean, max(sg) AS spend_mean,
         stddev_pop(revenue - (rw + rmo - rg)) AS revenue_std,
         stddev_pop(spend - (sw + smo - sg)) AS spend_std
  FROM fit GROUP BY ALL
),
wdm AS (SELECT {k}, wd, max(rw) AS rw, max(sw) AS sw FROM fit GROUP BY ALL),
mom AS (SELECT {k}, mo, max(rmo) AS rmo, max(smo) AS smo FROM fit GROUP BY ALL)"""


def least_squares(s: str = "series", fold: str = "") -> str:
    """lsrow .. lsstd: the portfolio's seasonal member, its normal equations solved by elimination without pivots."""
    k = f"{fold}dimension_type, dimension_value"
    return f"""
lsend AS (
  SELECT {k}, min(date) AS d0, max(date) AS d1 FROM {s} WHERE dimension_type = 'Overall' GROUP BY ALL
),
lsrow AS MATERIALIZED (
  SELECT {k}, date, revenue, spend, {design()} AS x FROM {s} JOIN lsend USING ({k})
),
lscell AS (
  SELECT {k}, i, j, sum(z[i] * z[j]) + CASE WHEN i = j THEN 1e-6 ELSE 0 END AS v
  FROM (SELECT *, list_concat(x, [revenue, spend]) AS z FROM lsrow)
  CROSS JOIN (SELECT range AS i FROM range(1, 29)) CROSS JOIN (SELECT range AS j FROM range(1, 31)) GROUP BY {k}, i, j
),
lsmat AS MATERIALIZED (
  SELECT {k}, list(r ORDER BY i) AS m
  FROM (SELECT {k}, i, list(v ORDER BY j) AS r FROM lscell GROUP BY {k}, i) GROUP BY {k}
),
lselim AS (
  SELECT {k}, 0 AS step, m FROM lsmat
  UNION ALL
  SELECT {k}, step + 1, [CASE WHEN i = step + 1 THEN [m[i][j] / m[i][i] FOR j IN range(1, 31)]
    ELSE [m[i][j] - m[i][step + 1] * m[step + 1][j] / m[step + 1][step + 1] FOR j IN range(1, 31)] END FOR i IN range(1, 29)]
  FROM lselim WHERE step < 28
),
lsbeta AS MATERIALIZED (
  SELECT {k}, d0, d1, [m[i][29] FOR i IN range(1, 29)] AS rb, [m[i][30] FOR i IN range(1, 29)] AS sb
  FROM lselim JOIN lsend USING ({k}) WHERE step = 28
),
lsstd AS (
  SELECT {k}, stddev_pop(revenue - list_dot_product(x, rb)) AS pstd FROM lsrow JOIN lsbeta USING ({k}) GROUP BY {k}
)"""


def design() -> str:
    """The design row of `date` for a series from d0 to d1."""
    days = ", ".join(f"CAST(isodow(date) = {d} AS DOUBLE)" for d in range(2, 8))
    return f"""list_concat([1.0::DOUBLE, date_diff('day', d1, date) / 365.25::DOUBLE, {days}],
    CASE WHEN date_diff('day', d0, date) IS NOT NULL AND date_diff('day', d0, d1) >= 365 THEN
      flatten([[cos(date_diff('day', d0, date) * (2 * pi() * h / 365.25)), sin(date_diff('day', d0, date) * (2 * pi() * h / 365.25))]
               FOR h IN range(1, 11)])
    ELSE [0.0::DOUBLE FOR h IN range(0, 20)] END)"""


def daily(start: str, fold: str = "", portfolio: bool = False) -> str:
    """daily: 90 days of blended revenue and spend; `start` is SQL for the first day.

    portfolio: whether the Overall series has its own members (after `least_squares`).
    """
    k = f"{fold}dimension_type, dimension_value"
    if portfolio:
        return daily(start, fold).replace("daily AS (", "daily0 AS (") + f""",
lsday AS (
  SELECT {k}, day, greatest(list_dot_product({design()}, rb), 0.0) AS pr, greatest(list_dot_product({design()}, sb), 1.0) AS ps, pstd
  FROM daily0 JOIN lsbeta USING ({k}) JOIN lsstd USING ({k})
),
daily AS (
  SELECT {k}, day, date, has_model, total_revenue, pstd, std_daily AS std0,
    CASE WHEN pr IS NULL THEN d.revenue ELSE
      greatest(0.08 * pr + 0.92 * (daily_revenue + revenue_trend_per_day * day * pow(0.92, day)), 0.0) END AS revenue,
    CASE WHEN pr IS NULL THEN d.spend ELSE
      greatest(0.25 * ps + 0.75 * (daily_spend + spend_trend_per_day * day * pow(0.92, day)), 1.0) END AS spend,
    coalesce(pstd, std_daily) AS std_daily
  FROM daily0 d LEFT JOIN lsday USING ({k}, day) JOIN anchors USING ({k})
)"""
    return f"""
fut AS (
  SELECT m.*, CAST(d.day AS INTEGER) AS day, CAST({start} + CAST(d.day AS INTEGER) - 1 AS DATE) AS date
  FROM model m CROSS JOIN (SELECT range AS day FROM range(1, 91)) d
),
futx AS (SELECT *, isodow(date) - 1 AS wd, month(date) AS mo FROM fut),
futm AS (
  SELECT f.*, coalesce(w.rw, f.revenue_mean) + coalesce(o.rmo, f.revenue_mean) - f.revenue_mean AS rmodel,
         coalesce(w.sw, f.spend_mean) + coalesce(o.smo, f.spend_mean) - f.spend_mean AS smodel
  FROM futx f LEFT JOIN wdm w USING ({k}, wd) LEFT JOIN mom o USING ({k}, mo)
),
daily AS (
  SELECT {k}, day, date, has_model, total_revenue,
    greatest(0.08 * greatest(rmodel, 0.0) + 0.92 * (daily_revenue
      + revenue_trend_per_day * day * pow(0.92, day)), 0.0) AS revenue,
    greatest(0.25 * greatest(smodel, CASE WHEN dimension_type = 'Overall' THEN 1.0 ELSE 0.1 END)
      + 0.75 * (daily_spend + spend_trend_per_day * day * pow(0.92, day)), 1.0) AS spend,
    revenue_std AS std_daily
  FROM futm JOIN anchors USING ({k})
)"""


def intervals(fold: str = "") -> str:
    """own: p10, p50, p90, spend of the three horizons."""
    k = f"{fold}dimension_type, dimension_value"
    return f"""
hs AS (
  SELECT {k}, h.label AS forecast_period, h.days, max(std_daily) AS sd, bool_or(has_model) AS has_model,
         max(total_revenue) AS total_revenue, sum(revenue) AS s50, sum(spend) AS spend
  FROM daily JOIN (VALUES ('30_days', 30), ('60_days', 60), ('90_days', 90)) h(label, days)
    ON day <= h.days
  GROUP BY ALL
),
own AS (
  SELECT {k}, forecast_period, has_model, total_revenue,
         greatest(0.0, greatest(s50 * 0.05, s50 - 1.28 * sd * pow(days, 0.75))) AS p10,
         greatest(0.0, s50) AS p50, greatest(0.0, s50 + 1.28 * sd * pow(days, 0.75)) AS p90, spend
  FROM hs
)"""


def campaign_map(s: str = "facts", fold: str = "") -> str:
    return f"""
cpairs AS (
  SELECT {fold}campaign_name, channel, count(*) AS n, sum(revenue) AS rev FROM {s} GROUP BY ALL
),
cprim AS (
  SELECT {fold}campaign_name, channel FROM cpairs
  QUALIFY row_number() OVER (PARTITION BY {fold}campaign_name ORDER BY n DESC, channel) = 1
),
crev AS (SELECT {fold}campaign_name, CAST(sum(rev) AS DOUBLE) AS crev FROM cpairs GROUP BY ALL),
chrev AS (SELECT {fold}channel, CAST(sum(rev) AS DOUBLE) AS chrev FROM cpairs GROUP BY ALL),
cmap AS (
  SELECT {fold}campaign_name, channel, CASE WHEN chrev > 0 THEN crev / chrev ELSE 0.0 END AS channel_share
  FROM cprim JOIN crev USING ({fold}campaign_name) JOIN chrev USING ({fold}channel)
)"""


def reconciled(fold: str = "") -> str:
    """forecast: own with campaigns pulled to their channel's share."""
    k = f"{fold}dimension_type, dimension_value"
    return f"""
recon AS (
  SELECT o.*, c.p50 AS ch50, m.channel_share
  FROM own o
  LEFT JOIN (SELECT {fold}'Campaign' AS dimension_type, campaign_name AS dimension_value, channel,
                    channel_share FROM cmap) m USING ({k})
  LEFT JOIN (SELECT {fold}dimension_value AS channel, forecast_period, p50 FROM own
             WHERE dimension_type = 'Channel') c USING ({fold}channel, forecast_period)
),
recont AS (
  SELECT *, has_model AND ch50 IS NOT NULL AND channel_share > 0 AS applies,
         0.5 * p50 + 0.5 * ch50 * channel_share AS target
  FROM recon
),
forecast AS (
  SELECT {k}, forecast_period, spend,
    CASE WHEN applies THEN greatest(0.0, p10 * CASE WHEN p50 > 0 THEN target / p50 ELSE 1.0 END) ELSE p10 END AS p10,
    CASE WHEN applies THEN target ELSE p50 END AS p50,
    CASE WHEN applies THEN p90 * CASE WHEN p50 > 0 THEN target / p50 ELSE 1.0 END ELSE p90 END AS p90
  FROM recont
)"""


def predictions(fold: str = "", top_from: str = "facts") -> str:
    part = f"PARTITION BY {fold.strip().rstrip(',')} " if fold else ""
    return f"""
topc AS (
  SELECT {fold}campaign_name FROM (
    SELECT {fold}campaign_name, sum(revenue) AS rev FROM {top_from} GROUP BY ALL)
  QUALIFY row_number() OVER ({part}ORDER BY rev DESC, campaign_name) <= 10
),
chosen AS (
  SELECT * FROM forecast WHERE dimension_type <> 'Campaign'
  UNION ALL BY NAME
  SELECT f.* FROM forecast f SEMI JOIN topc t
    ON f.dimension_type = 'Campaign' AND f.dimension_value = t.campaign_name
    {'AND f.origin_date = t.origin_date' if fold else ''}
),
predictions AS (
  SELECT {fold}forecast_period, dimension_type, dimension_value, 'Revenue' AS metric,
         round_even(p10, 2) AS p10, round_even(p50, 2) AS p50, round_even(p90, 2) AS p90 FROM chosen
  UNION ALL BY NAME
  SELECT {fold}forecast_period, dimension_type, dimension_value, 'ROAS' AS metric,
         round_even(p10 / spend, 2) AS p10, round_even(p50 / spend, 2) AS p50,
         round_even(p90 / spend, 2) AS p90 FROM chosen
)"""


START = "(SELECT max(date) + 1 FROM series)"
MODELS = ",".join([SERIES, anchors(), effects()])
DAILY = ",".join([MODELS, daily(START)])
OWN = ",".join([DAILY, intervals()])
LEVELS = ",".join([MODELS, least_squares(), daily(START, portfolio=True), intervals()])
FORECAST = ",".join([LEVELS, campaign_map(), reconciled()])
PREDICTIONS = ",".join([FORECAST, predictions()])


def origins(n: int) -> str:
    """orig: n forecast dates spread over the usable history, as in 120 days .. 90 days."""
    return f"""
ends AS (SELECT min(date) + 120 AS lo, max(date) - 89 AS hi FROM series),
orig AS (
  SELECT DISTINCT CAST(lo + CAST(floor((hi - lo) * i / CAST({n - 1} AS DOUBLE)) AS INTEGER) AS DATE) AS origin_date
  FROM ends CROSS JOIN (SELECT range AS i FROM range(0, {n})) WHERE hi >= lo
)"""


def fold_actuals() -> str:
    return """
act AS (
  SELECT origin_date, dimension_type, dimension_value, h.label AS forecast_period,
         CAST(sum(CAST(revenue AS DECIMAL(28,6))) AS DOUBLE) AS revenue,
         CAST(sum(CAST(spend AS DECIMAL(28,6))) AS DOUBLE) AS spend
  FROM series JOIN orig ON date >= origin_date AND date < origin_date + 90
  JOIN (VALUES ('30_days', 30), ('60_days', 60), ('90_days', 90)) h(label, days)
    ON date < origin_date + h.days
  GROUP BY ALL
),
actl AS (
  SELECT origin_date, dimension_type, dimension_value, forecast_period, 'Revenue' AS metric,
         revenue AS actual FROM act
  UNION ALL
  SELECT origin_date, dimension_type, dimension_value, forecast_period, 'ROAS',
         CASE WHEN abs(spend) < 1e-9 THEN 0.0 ELSE revenue / spend END FROM act
)"""


def backtest(n: int) -> str:
    """Everything up to scorecard and naive_scores."""
    f = "origin_date, "
    return ",".join([
        SERIES, origins(n), """
train AS (
  SELECT o.origin_date, s.* FROM series s JOIN orig o ON s.date < o.origin_date
  WHERE o.origin_date IN (SELECT origin_date FROM series JOIN orig ON date < origin_date
                          GROUP BY origin_date HAVING count(DISTINCT date) >= 14)
),
ffacts AS (SELECT o.origin_date, f.* FROM facts f JOIN orig o ON f.date < o.origin_date)""",
        anchors("train", f), effects("train", f), least_squares("train", f), daily("m.origin_date", f, True), intervals(f),
        campaign_map("ffacts", f), reconciled(f), predictions(f, "ffacts"), fold_actuals(), """
scorecard AS (
  SELECT origin_date, dimension_type, dimension_value, forecast_period, metric,
    round_even(actual, 4) AS actual, p10, p50, p90, round_even(abs(p50 - actual), 4) AS absolute_error,
    round_even(CASE WHEN abs(actual) < 1e-9 THEN 0.0 ELSE abs(p50 - actual) / abs(actual) END * 100.0, 4) AS ape,
    round_even(CASE WHEN abs(actual) + abs(p50) < 1e-9 THEN 0.0
      ELSE 200.0 * abs(p50 - actual) / (abs(actual) + abs(p50)) END, 4) AS smape,
    p10 <= actual AND actual <= p90 AS covered_by_interval
  FROM predictions JOIN actl USING (origin_date, dimension_type, dimension_value, forecast_period, metric)
),
navg AS (
  SELECT origin_date, CAST(sum(CAST(revenue AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS avg_revenue,
         CAST(sum(CAST(spend AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS avg_spend
  FROM series JOIN orig ON date < origin_date AND date >= origin_date - 30
  WHERE dimension_type = 'Overall' GROUP BY origin_date
),
npred AS (
  SELECT origin_date, h.label AS forecast_period, m.metric,
    CASE WHEN m.metric = 'Revenue' THEN avg_revenue * h.days
         WHEN abs(avg_spend) < 1e-9 THEN 0.0 ELSE avg_revenue / avg_spend END AS predicted
  FROM navg CROSS JOIN (VALUES ('30_days', 30), ('60_days', 60), ('90_days', 90)) h(label, days)
  CROSS JOIN (VALUES ('Revenue'), ('ROAS')) m(metric)
),
naive_scores AS (
  SELECT origin_date, forecast_period, metric, round_even(actual, 4) AS actual,
    round_even(predicted, 4) AS predicted, round_even(abs(predicted - actual), 4) AS absolute_error,
    round_even(CASE WHEN abs(actual) < 1e-9 THEN 0.0 ELSE abs(predicted - actual) / abs(actual) END * 100.0, 4) AS ape
  FROM npred JOIN (SELECT * FROM actl WHERE dimension_type = 'Overall')
    USING (origin_date, forecast_period, metric)
),
segments AS (
  SELECT metric, forecast_period, dimension_type, count(*) AS rows,
    avg(absolute_error) AS mae, sqrt(avg(absolute_error * absolute_error)) AS rmse, avg(ape) AS mape,
    avg(smape) AS smape,
    CASE WHEN sum(abs(actual)) < 1e-9 THEN 0.0 ELSE sum(abs(actual - p50)) / sum(abs(actual)) END * 100.0 AS wape,
    avg(CAST(covered_by_interval AS INTEGER)) * 100.0 AS interval_coverage
  FROM scorecard GROUP BY ALL
),
comparison AS (
  SELECT n.*, e.* EXCLUDE (metric, forecast_period),
    round_even(ensemble_mape, 4) < round_even(naive_baseline_mape, 4) AS ensemble_beats_naive_baseline,
    CASE WHEN round_even(naive_baseline_mape, 4) <> 0 THEN
      (round_even(naive_baseline_mape, 4) - round_even(ensemble_mape, 4))
        / round_even(naive_baseline_mape, 4) * 100.0 END AS mape_improvement_pct
  FROM (SELECT metric, forecast_period, avg(absolute_error) AS naive_baseline_mae,
          sqrt(avg(absolute_error * absolute_error)) AS naive_baseline_rmse, avg(ape) AS naive_baseline_mape
        FROM naive_scores GROUP BY ALL) n
  JOIN (SELECT metric, forecast_period, avg(absolute_error) AS ensemble_mae,
          sqrt(avg(absolute_error * absolute_error)) AS ensemble_rmse, avg(ape) AS ensemble_mape
        FROM scorecard WHERE dimension_type = 'Overall' GROUP BY ALL) e USING (metric, forecast_period)
)"""])


CURVES = FACTS + """,
months AS (
  SELECT channel, date_trunc('month', date) AS month, CAST(sum(spend) AS DOUBLE) AS spend,
         CAST(sum(revenue) AS DOUBLE) AS revenue
  FROM facts GROUP BY ALL
),
curve0 AS (
  SELECT channel, CASE channel WHEN 'Google Ads' THEN 0.85 WHEN 'Meta Ads' THEN 0.82
                  WHEN 'Bing Ads' THEN 0.78 ELSE 0.80 END::DOUBLE AS beta,
    count(*) FILTER (spend > 0 AND revenue > 0) AS n, avg(spend) FILTER (spend > 0 AND revenue > 0) AS ms,
    avg(revenue) FILTER (spend > 0 AND revenue > 0) AS mr, sum(revenue) / (sum(spend) + 1e-5) AS base_roas
  FROM months GROUP BY channel
),
curve1 AS (
  SELECT *, CASE WHEN n > 0 THEN mr / pow(ms, beta) ELSE base_roas * pow(10000.0, 1 - beta) END AS alpha
  FROM curve0
),
curves AS (
  SELECT channel, alpha, beta, base_roas, CASE WHEN n >= 2 THEN least(greatest((
      SELECT stddev_pop((m.revenue - alpha * pow(m.spend, beta)) / (alpha * pow(m.spend, beta) + 1e-5))
      FROM months m WHERE m.channel = c.channel AND m.spend > 0 AND m.revenue > 0), 0.0), 0.6)
    ELSE 0.15 END AS fit_cv
  FROM curve1 c
),
rates AS (
  SELECT channel, CASE WHEN s > 0 THEN s ELSE coalesce(avg(s) FILTER (s > 0) OVER (), 25000.0) END AS spend
  FROM (SELECT channel, CAST(sum(spend) AS DOUBLE) / (SELECT count(DISTINCT date) FROM facts) * 30 AS s
        FROM facts GROUP BY channel)
)"""


def allocation(budget: float, target: float, steps: int = 200, lower: float = 0.01,
               curves: str | None = None) -> str:
    inc = budget / steps
    return (curves or CURVES) + f""",
eq AS (SELECT *, alpha * pow({budget} / count(*) OVER (), beta) AS e, count(*) OVER () AS nch FROM curves),
bounds AS (
  SELECT channel, alpha, beta, base_roas, fit_cv, e / sum(e) OVER () AS equal_split_share,
    {budget * lower} AS lower,
    greatest({budget * lower}, CASE WHEN e / sum(e) OVER () < 0.1
      THEN least(greatest(e / sum(e) OVER () * {budget} * 2.5, {budget} * 0.02), {budget} * 0.15)
      ELSE {budget} * 0.85 END) AS upper
  FROM eq
),
ladder AS (
  SELECT channel, step, hi - lo AS add_spend, alpha * (pow(hi, beta) - pow(lo, beta)) AS add_revenue,
    alpha * (pow(hi, beta) - pow(lo, beta)) / (hi - lo) AS marginal
  FROM (SELECT channel, alpha, beta, step, lower + (step - 1) * {inc} AS lo,
          CASE WHEN upper < lower + step * {inc} THEN upper ELSE lower + step * {inc} END AS hi
        FROM bounds JOIN (SELECT range AS step FROM range(1, {steps + 1})) s
          ON lower + (step - 1) * {inc} < upper - 1e-9 * {inc}) AS cells
),
base AS (SELECT sum(lower) AS s0, sum(alpha * pow(lower, beta)) AS r0 FROM bounds),
walk AS (
  SELECT channel, step, marginal, add_spend,
    row_number() OVER w AS position, s0 + sum(add_spend) OVER w AS spend, r0 + sum(add_revenue) OVER w AS revenue
  FROM ladder, base
  WINDOW w AS (ORDER BY round(marginal, 9) DESC, channel, step ROWS UNBOUNDED PRECEDING)
),
prefixes AS (
  SELECT position, spend, revenue, revenue / (spend + 1e-5) AS roas FROM (
    SELECT position, spend, revenue FROM walk UNION ALL SELECT 0, s0, r0 FROM base)
),
cut AS (
  SELECT coalesce(
    (SELECT max(position) FROM prefixes WHERE spend <= {budget} * (1 + 1e-9) AND roas >= {target}),
    (SELECT position FROM prefixes WHERE spend <= {budget} * (1 + 1e-9)
     ORDER BY roas DESC, position DESC LIMIT 1)) AS cut
),
alloc0 AS (
  SELECT b.*, lower + coalesce((SELECT sum(add_spend) FROM walk w, cut WHERE w.channel = b.channel
                                AND position <= cut), 0) AS allocated_spend
  FROM bounds b
),
alloc AS (
  SELECT channel, allocated_spend, alpha * pow(allocated_spend, beta) AS expected_revenue,
    alpha * pow(allocated_spend, beta) / allocated_spend AS expected_roas,
    allocated_spend / sum(allocated_spend) OVER () * 100.0 AS budget_share, fit_cv
  FROM alloc0
)"""


def allocation_exact(budget: float, target: float, lower: float = 0.01, curves: str | None = None) -> str:
    """The multiplier by halving, once for the budget and once for the target."""
    start = allocation(budget, target, lower=lower, curves=curves).split(",\nladder AS")[0]
    spend = "CASE WHEN x.a > 0 THEN greatest(x.l, least(x.u, pow(exp({m}) / (x.a * x.b), 1 / (x.b - 1)))) ELSE x.l END"
    total = f"list_sum([{spend.format(m='(lo + hi) / 2')} FOR x IN c])"
    roas = f"list_sum([x.a * pow({spend.format(m='(lo + hi) / 2')}, x.b) FOR x IN c]) / {total}"

    def halved(name: str, enough: str) -> str:
        return f"""
{name} AS (
  SELECT 0 AS step, lo, hi FROM ends
  UNION ALL
  SELECT step + 1, CASE WHEN {enough} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {enough} THEN hi ELSE (lo + hi) / 2 END
  FROM {name}, packed WHERE step < 60
)"""

    return start + f""",
packed AS MATERIALIZED (SELECT list(struct_pack(a := alpha, b := beta, l := lower, u := upper)) AS c FROM bounds),
ends AS (SELECT ln(min(alpha * beta * pow(upper, beta - 1))) - 1e-6 AS lo, ln(max(alpha * beta * pow(lower, beta - 1))) + 1e-6 AS hi
  FROM bounds WHERE alpha > 0),{halved("within", f"{total} > {budget}")},{halved("floored", f"{roas} < {target} AND exp((lo + hi) / 2) <= {roas}")},
alloc0 AS (
  SELECT channel, alpha, beta, fit_cv, CASE WHEN alpha > 0 THEN greatest(lower, least(upper, pow(exp(greatest(
    (SELECT hi FROM within WHERE step = 60), (SELECT hi FROM floored WHERE step = 60))) / (alpha * beta), 1 / (beta - 1)))) ELSE lower END
    AS allocated_spend FROM bounds
),
alloc AS (
  SELECT channel, allocated_spend, alpha * pow(allocated_spend, beta) AS expected_revenue,
    alpha * pow(allocated_spend, beta) / allocated_spend AS expected_roas,
    allocated_spend / sum(allocated_spend) OVER () * 100.0 AS budget_share, fit_cv
  FROM alloc0
)"""


# The raw exports as text, all three return flags.
RAW = """
rawx AS (
  SELECT l_returnflag AS flag, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS pos, l_orderkey, l_linenumber, l_partkey, CAST(l_partkey AS VARCHAR) AS id,
    CASE WHEN l_quantity = 1 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day,
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS clicks,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(l_discount AS DECIMAL(4,2))
      + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,4))
      * CASE WHEN CAST(l_tax AS DECIMAL(4,2)) = 0 THEN -1 ELSE 1 END AS cost,
    CASE WHEN l_quantity > 45 THEN 0 ELSE CAST(l_quantity * p_size AS INTEGER) END AS shown,
    CASE WHEN CAST(l_discount AS DECIMAL(4,2)) = 0 THEN 'n/a'
      ELSE CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
        AS DECIMAL(18,4)) AS VARCHAR) END AS value,
    CASE p_type WHEN 'PROMO' THEN 'PerformanceMax' WHEN 'ECONOMY' THEN NULL
      WHEN 'LARGE' THEN 'Demand - Gen' ELSE lower(p_type) END AS kind,
    CASE WHEN p_size = 50 THEN NULL ELSE p_brand END AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
rawd AS (
  SELECT *, coalesce(first_value(TRY_CAST(day AS DATE) IGNORE NULLS) OVER (
      PARTITION BY flag ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      DATE '2025-01-01') AS date,
    TRY_CAST(day AS DATE) IS NULL AS bad_date, coalesce(TRY_CAST(value AS DECIMAL(18,6)), 0) AS rev,
    regexp_replace(coalesce(kind, 'SEARCH'), '([a-z])([A-Z])', '\\1_\\2', 'g') AS kind1
  FROM rawx
),
google AS (
  SELECT l_orderkey, l_linenumber, l_partkey, date, bad_date, 'Google Ads' AS channel, id AS campaign_id,
    coalesce(name, 'Google_Generic_Campaign') AS campaign_name,
    upper(regexp_replace(kind1, '[\\s\\-]+', '_', 'g')) AS campaign_type, CAST(cost AS DECIMAL(18,6)) AS spend,
    rev AS revenue, CAST(clicks AS DOUBLE) AS clicks, CAST(shown AS DOUBLE) AS impressions,
    CAST(1 AS DOUBLE) AS conversions
  FROM rawd WHERE flag = 'A'
),
bing AS (
  SELECT l_orderkey, l_linenumber, l_partkey, date, bad_date, 'Bing Ads' AS channel, id AS campaign_id,
    coalesce(name, 'Bing_Generic_Campaign') AS campaign_name, upper(kind1) AS campaign_type,
    CAST(cost AS DECIMAL(18,6)) AS spend, rev AS revenue, CAST(0 AS DOUBLE) AS clicks,
    CAST(shown AS DOUBLE) AS impressions, CAST(1 AS DOUBLE) AS conversions
  FROM rawd WHERE flag = 'N'
),
rpc AS (
  SELECT CASE WHEN sum(conversions) > 0 THEN CAST(sum(greatest(revenue, 0)) AS DOUBLE) / sum(conversions)
    ELSE 50.0 END AS per_conversion
  FROM (SELECT * FROM google UNION ALL SELECT * FROM bing)
),
meta AS (
  SELECT l_orderkey, l_linenumber, l_partkey, date, bad_date, 'Meta Ads' AS channel, id AS campaign_id,
    coalesce(name, 'Meta_Generic_Campaign') AS campaign_name, 'SOCIAL' AS campaign_type,
    CAST(cost AS DECIMAL(18,6)) AS spend, rev AS revenue, CAST(clicks AS DOUBLE) AS clicks,
    CAST(shown AS DOUBLE) AS impressions, CAST(rev AS DOUBLE) / per_conversion AS conversions
  FROM rawd, rpc WHERE flag = 'R'
),
unified AS (
  SELECT date, channel, campaign_id, campaign_name, campaign_type, greatest(spend, 0) AS spend,
    greatest(revenue, 0) AS revenue, clicks, impressions, conversions
  FROM (SELECT * FROM google UNION ALL SELECT * FROM bing UNION ALL SELECT * FROM meta)
),
merged AS (
  SELECT date, channel, campaign_id, campaign_name, campaign_type, sum(spend) AS spend,
    sum(revenue) AS revenue, sum(clicks) AS clicks, sum(impressions) AS impressions,
    sum(conversions) AS conversions, count(*) AS source_rows
  FROM unified GROUP BY ALL
)"""

# What the audits of the exports charge, and the score that is left.
LEDGER = RAW + """,
counts AS (
  SELECT channel, count(*) AS n, count(*) FILTER (bad_date) AS bad, count(*) FILTER (spend < 0) AS ns,
    count(*) FILTER (revenue < 0) AS nr, count(*) FILTER (spend < 0 OR revenue < 0) AS na,
    count(*) FILTER (spend > 1000 AND impressions = 0) AS sus,
    count(*) FILTER (CAST(spend AS DOUBLE) > 3 * (SELECT quantile_cont(CAST(greatest(spend, 0) AS DOUBLE), 0.99)
      FROM meta)) AS outl
  FROM (SELECT * FROM google UNION ALL SELECT * FROM bing UNION ALL SELECT * FROM meta) GROUP BY channel
),
ledger AS (
  SELECT CASE channel WHEN 'Google Ads' THEN 'google' WHEN 'Bing Ads' THEN 'bing' ELSE 'meta' END AS platform,
    u.check_, u.affected, u.penalty FROM counts, LATERAL (VALUES
    ('rows_read', n, 0), ('bad_dates', bad, 2),
    ('negative_spend', CASE WHEN channel = 'Google Ads' THEN ns ELSE 0 END, 3),
    ('negative_revenue', CASE WHEN channel = 'Google Ads' THEN nr ELSE 0 END, 3),
    ('negative_money', CASE WHEN channel <> 'Google Ads' THEN na ELSE 0 END, 3),
    ('suspicious', CASE WHEN channel = 'Google Ads' THEN sus ELSE 0 END, 4),
    ('spend_outliers', CASE WHEN channel = 'Meta Ads' THEN outl ELSE 0 END, 2),
    ('column_missing:Clicks', CASE WHEN channel = 'Bing Ads' THEN 1 ELSE 0 END, 5),
    ('column_imputed:Clicks', CASE WHEN channel = 'Bing Ads' THEN 1 ELSE 0 END, 5)) u(check_, affected, penalty)
  WHERE u.affected > 0
  UNION ALL
  SELECT 'all', 'duplicates', n, 3 FROM (SELECT count(*) - (SELECT count(*) FROM (
    SELECT DISTINCT date, channel, campaign_id FROM unified)) AS n FROM unified) WHERE n > 0
)"""

QUALITY = "WITH " + LEDGER + """
  SELECT round_even(least(greatest(100.0 - coalesce(sum(penalty), 0), 10.0), 100.0), 1) FROM ledger"""


RISK = FACTS + """,
weekly AS (
  SELECT channel, date_trunc('week', date) AS week, sum(revenue) AS revenue, sum(spend) AS spend
  FROM facts GROUP BY ALL
),
wtot AS (
  SELECT week, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(spend) AS DOUBLE) AS spend,
         CAST(sum(revenue) AS DOUBLE) / (CAST(sum(spend) AS DOUBLE) + 1e-5) AS roas
  FROM weekly GROUP BY week
),
wcv AS (
  SELECT coalesce(stddev_samp(revenue) FILTER (revenue > 0) / (avg(revenue) FILTER (revenue > 0) + 1e-5), 0) AS revenue_cv,
         coalesce(stddev_samp(roas) FILTER (roas > 0) / (avg(roas) FILTER (roas > 0) + 1e-5), 0) AS roas_cv,
         count(*) FILTER (roas > 0) AS weeks
  FROM wtot
),
wch AS (
  SELECT channel, coalesce(stddev_samp(roas) FILTER (roas > 0) / (avg(roas) FILTER (roas > 0) + 1e-5), 0) AS roas_cv,
         count(*) FILTER (roas > 0) AS weeks
  FROM (SELECT channel, CAST(revenue AS DOUBLE) / (CAST(spend AS DOUBLE) + 1e-5) AS roas FROM weekly)
  GROUP BY channel
),
shares AS (
  SELECT channel, revenue, revenue / sum(revenue) OVER () AS share
  FROM (SELECT channel, CAST(sum(revenue) AS DOUBLE) AS revenue FROM weekly GROUP BY channel)
),
conc AS (
  SELECT sum(share * share) AS hhi, round_even(max(share) * 100.0, 1) AS top_share_pct,
    (SELECT channel FROM shares ORDER BY share DESC, channel LIMIT 1) AS top_channel
  FROM shares
),
quality AS (
  SELECT (""" + QUALITY + """) AS quality_score
),
risk0 AS (
  SELECT least(greatest(revenue_cv * 100.0, 0.0), 100.0) AS revenue_volatility,
    least(greatest((hhi - 0.33) * 150.0, 0.0), 100.0) AS channel_dependency,
    least(greatest(roas_cv * 120.0, 0.0), 100.0) AS roas_instability,
    100.0 - quality_score AS data_quality, quality_score, hhi, top_channel, top_share_pct,
    (SELECT channel FROM wch WHERE weeks >= 2 ORDER BY roas_cv DESC, channel LIMIT 1) AS volatile_channel
  FROM wcv, conc, quality
),
risk AS (
  SELECT *, round_even(0.30 * revenue_volatility + 0.25 * channel_dependency + 0.30 * roas_instability
    + 0.15 * data_quality, 1) AS risk_score,
    CASE WHEN round_even(0.30 * revenue_volatility + 0.25 * channel_dependency + 0.30 * roas_instability
    + 0.15 * data_quality, 1) < 35 THEN 'Low Risk'
    WHEN round_even(0.30 * revenue_volatility + 0.25 * channel_dependency + 0.30 * roas_instability
    + 0.15 * data_quality, 1) < 65 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_classification
  FROM risk0
)"""


EVENTS = """
adrows AS (
  SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'Google Ads' WHEN 1 THEN 'Meta Ads' ELSE 'Bing Ads' END AS channel,
    CASE WHEN event_type = 'click' THEN CAST(CAST(value AS DECIMAL(18,4)) * 0.1 AS DECIMAL(18,4)) ELSE 0 END AS spend,
    CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) ELSE 0 END AS revenue,
    CAST(event_type = 'click' AS BIGINT) AS clicks, CAST(event_type = 'view' AS BIGINT) AS impressions,
    CAST(event_type = 'purchase' AS BIGINT) AS conversions
  FROM events WHERE event_type IN ('view', 'click', 'purchase')
),
eventdays AS (
  SELECT CAST(ts AS DATE) AS date, channel, sum(spend) AS spend, sum(revenue) AS revenue, sum(clicks) AS clicks,
    sum(impressions) AS impressions, sum(conversions) AS conversions
  FROM adrows GROUP BY ALL
)"""
