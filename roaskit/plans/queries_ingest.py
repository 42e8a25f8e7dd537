"""Queries on ingest, features and entity series."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.attach import scalar_of
from roaskit.functions.scalars import normalize_name, strip_markdown, tag_intent
from roaskit.operators import entities as E
from roaskit.operators import features as FE
from roaskit.operators import ingest as I
from roaskit.operators.quantiles import count_over_percentile, equal_width_histogram, quantile_cases
from roaskit.plans import sql as S
from roaskit.plans.catalog import query
from roaskit.sources import state
from roaskit.sources.storage import materialize, shared_root
from roaskit.sources.tables import campaign_facts, raw_export, table


def raw_exports(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {p: raw_export(spark, sf, p) for p in ("google", "bing", "meta")}


def meta_value(spark: SparkSession, sf: str) -> DataFrame:
    """One row: dollars for each conversion of google and bing."""
    known = [I.clip_negative(make(raw_export(spark, sf, p))).select("revenue", "conversions")
             for p, make in (("google", I.google_rows), ("bing", I.bing_rows))]
    return I.revenue_per_conversion(known[0].unionByName(known[1]))


def meta_rows(spark: SparkSession, sf: str) -> DataFrame:
    per = scalar_of(meta_value(spark, sf), "per_conversion")["per_conversion"]
    return I.meta_rows(raw_export(spark, sf, "meta"), per)


def unified(spark: SparkSession, sf: str) -> DataFrame:
    return I.typed_facts(I.typed_exports(**raw_exports(spark, sf)))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The audit of the exports, done anew and stored for those who only need its score."""
    inputs = _inputs(spark, sf)
    found = materialize(I.ingest_ledger(**raw_exports(spark, sf)), "ledger")
    state.save_ledger(found, _ledger_path(spark, sf), inputs)
    return found


def stored_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger as the last audit stored it; done anew if there is none or a file has changed since."""
    found = state.load_ledger(spark, _ledger_path(spark, sf), _inputs(spark, sf))
    return ledger(spark, sf) if found is None else found


def _inputs(spark: SparkSession, sf: str) -> str:
    """The exports' files as they are, and the rules they are audited by."""
    return f"rules {I.AUDIT_RULES} files {state.files_state(table(spark, sf, 'lineitem'), table(spark, sf, 'part'))}"


def _ledger_path(spark: SparkSession, sf: str) -> str:
    return f"{shared_root(spark)}/roaskit/ledgers/{hashlib.sha256(sf.rstrip('/').encode()).hexdigest()[:16]}"


@query("normalize_name", "p_partkey:i name:s",
       "result AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower('_' || p_name || ' - ' || p_brand), "
       "'[ -]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM part)")
def _(spark, sf):
    text = F.concat(F.lit("_"), "p_name", F.lit(" - "), "p_brand")
    return table(spark, sf, "part").select("p_partkey", normalize_name(text).alias("name"))


ROW_SPEC = ("date:d channel:s campaign_id:s campaign_name:s campaign_type:s spend:6 revenue:6 "
            "clicks:2 impressions:2 conversions:6")


@query("parse_dates_bfill", "l_orderkey:i l_linenumber:i l_partkey:i date:d bad_date:b",
       S.RAW + ", result AS (SELECT * FROM google)")
def _(spark, sf):
    rows = I.fill_dates(I.standard_columns(raw_export(spark, sf, "google"), I.GOOGLE),
                        "s_segments_date")
    return rows.select("_pos.*", "date", F.col("_bad_date").alias("bad_date"))


@query("google_export", ROW_SPEC, S.RAW + ", result AS (SELECT * FROM google)")
def _(spark, sf):
    """Aliases, micros to dollars, numbers, types and names of the google export."""
    return I.read_google(raw_export(spark, sf, "google"))


@query("bing_export", ROW_SPEC, S.RAW + ", result AS (SELECT * FROM bing)")
def _(spark, sf):
    """An export without a clicks column: it is imputed."""
    return I.read_bing(raw_export(spark, sf, "bing"))


@query("meta_export", ROW_SPEC, S.RAW + ", result AS (SELECT * FROM meta)")
def _(spark, sf):
    """Revenue picked from the value column; conversions from the others' average."""
    return I.fill_dates(meta_rows(spark, sf), "_day")


@query("clip_negative", "channel:s rows:i spend:4 revenue:4", S.RAW + """, result AS (
  SELECT channel, count(*) AS rows, sum(greatest(spend, 0)) AS spend, sum(greatest(revenue, 0)) AS revenue
  FROM google GROUP BY channel)""")
def _(spark, sf):
    rows = I.google_rows(raw_export(spark, sf, "google"))
    return I.clip_negative(rows).groupBy("channel").agg(
        F.count("*").alias("rows"), F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"))


@query("suspicious_rows", ROW_SPEC, S.RAW + """, result AS (
  SELECT * FROM google WHERE spend > 1000 AND impressions = 0)""")
def _(spark, sf):
    return I.suspicious_rows(I.read_google(raw_export(spark, sf, "google")))


@query("outlier_counts", "factor:2 above:i", S.RAW + """, result AS (
  SELECT factor, count(*) FILTER (CAST(greatest(spend, 0) AS DOUBLE) > factor * p) AS above
  FROM meta CROSS JOIN (VALUES (3.0::DOUBLE), (0.55::DOUBLE), (0.01::DOUBLE)) f(factor)
  CROSS JOIN (SELECT quantile_cont(CAST(greatest(spend, 0) AS DOUBLE), 0.99) AS p FROM meta) GROUP BY factor)""")
def _(spark, sf):
    """Rows over a factor times the 99th percentile: the factor in use, and two that have rows."""
    rows = materialize(I.clip_negative(meta_rows(spark, sf)).select("spend"), "spend")
    out = [count_over_percentile(rows, "spend", 0.99, f).select(F.lit(f).alias("factor"), "above") for f in (3.0, 0.55, 0.01)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("spend_outliers", ROW_SPEC, S.RAW + """, result AS (
  SELECT * FROM meta WHERE CAST(spend AS DOUBLE) > 0.55 *
    (SELECT quantile_cont(CAST(spend AS DOUBLE), 0.99) FROM meta))""")
def _(spark, sf):
    # The factor in use is 3; here it is lower, so that there are rows to compare.
    return I.spend_outliers(I.fill_dates(meta_rows(spark, sf), "_day"), factor=0.55)


LEDGER_SQL = S.LEDGER



@query("quality_ledger", "platform:s check_:s affected:i penalty:1", LEDGER_SQL, "ledger")
def _(spark, sf):
    return ledger(spark, sf).withColumnRenamed("check", "check_")


@query("quality_score", "quality_score:1 critical_warnings:i", LEDGER_SQL + """, result AS (
  SELECT least(greatest(100.0 - sum(penalty), 10.0), 100.0) AS quality_score,
    count(*) FILTER (penalty >= 5) AS critical_warnings FROM ledger)""")
def _(spark, sf):
    return I.quality_score(ledger(spark, sf))


@query("revenue_per_conversion", "per_conversion:6", S.RAW, "rpc")
def _(spark, sf):
    return meta_value(spark, sf)


@query("unify_channels", ROW_SPEC + " source_rows:i", S.RAW, "merged")
def _(spark, sf):
    """All exports in one table, repeated keys summed."""
    return I.merge_duplicates(unified(spark, sf))


@query("duplicate_count", "duplicates:i", S.RAW + """, result AS (
  SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT date, channel, campaign_id FROM unified)) AS duplicates
  FROM unified)""")
def _(spark, sf):
    return I.duplicate_count(I.merge_duplicates(unified(spark, sf)))


@query("duplicate_rows", "l_orderkey:i l_linenumber:i date:d campaign_id:s", """
d AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date, l_returnflag AS channel,
  CAST(l_partkey AS VARCHAR) AS campaign_id, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
result AS (SELECT * FROM d QUALIFY row_number() OVER (
  PARTITION BY date, channel, campaign_id ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity,
  l_extendedprice) > 1)""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"),
        F.col("l_returnflag").alias("channel"), F.col("l_partkey").cast("string").alias("campaign_id"),
        "l_suppkey", "l_quantity", "l_extendedprice")
    return I.duplicate_rows(rows, ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity",
                                   "l_extendedprice"])


@query("validation_summary", "total_records:i channels:i google:i bing:i meta:i min_date:s max_date:s "
       "total_spend:4 total_revenue:4 overall_roas:6", S.RAW + """, result AS (
  SELECT count(*) AS total_records, count(DISTINCT channel) AS channels,
    count(*) FILTER (channel = 'Google Ads') AS google, count(*) FILTER (channel = 'Bing Ads') AS bing,
    count(*) FILTER (channel = 'Meta Ads') AS meta, strftime(min(date), '%Y-%m-%d') AS min_date,
    strftime(max(date), '%Y-%m-%d') AS max_date, CAST(sum(spend) AS DOUBLE) AS total_spend,
    CAST(sum(revenue) AS DOUBLE) AS total_revenue,
    CAST(sum(revenue) AS DOUBLE) / (CAST(sum(spend) AS DOUBLE) + 1e-5) AS overall_roas
  FROM merged)""")
def _(spark, sf):
    s = I.validation_summary(I.merge_duplicates(unified(spark, sf)))
    per = "channel_record_counts"
    return s.select("*", *[F.element_at(per, F.lit(c)).alias(n) for n, c in (
        ("google", "Google Ads"), ("bing", "Bing Ads"), ("meta", "Meta Ads"))])


# Features.

def cube(spark: SparkSession, sf: str) -> DataFrame:
    return E.daily_cube(campaign_facts(spark, sf))


MEASURE_SUMS = ", ".join(f"sum({m}) AS {m}" for m in E.MEASURES)


@query("campaign_facts", ROW_SPEC, S.FACTS, "facts")
def _(spark, sf):
    return campaign_facts(spark, sf)


@query("daily_cube", "date:d channel:s campaign_type:s campaign_name:s spend:4 revenue:4 clicks:1 "
       "impressions:1 conversions:1 fact_rows:i", S.FACTS + f""", result AS (
  SELECT date, channel, campaign_type, campaign_name, {MEASURE_SUMS}, count(*) AS fact_rows
  FROM facts GROUP BY ALL)""")
def _(spark, sf):
    return cube(spark, sf)


@query("daily_totals", "date:d spend:4 revenue:4 clicks:1 impressions:1 conversions:1",
       S.FACTS + f", result AS (SELECT date, {MEASURE_SUMS} FROM facts GROUP BY date)")
def _(spark, sf):
    return FE.daily_totals(cube(spark, sf))


def _roll_sql() -> str:
    cols = []
    for w in FE.WINDOWS:
        fr = f"OVER (ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        for m in ("revenue", "spend"):
            cols.append(f"coalesce(CAST(sum({m}) {fr} AS DOUBLE) / nullif(count(*) {fr}, 0), "
                        f"CAST(sum({m}) OVER () AS DOUBLE) / count(*) OVER ()) AS rolling_{m}_{w}d")
        for m in ("roas", "conversion_rate"):
            cols.append(f"coalesce(avg({m}) {fr}, avg({m}) OVER ()) AS rolling_{m}_{w}d")
        for m in ("revenue", "spend", "roas"):
            cols.append(f"coalesce(stddev_samp(CAST({m} AS DOUBLE)) {fr}, 0) AS moving_std_{m}_{w}d")
    later = [f"pow(moving_std_revenue_{w}d, 2) / 1e6 AS variance_revenue_{w}d, (lag_revenue - rolling_revenue_{w}d) "
             f"/ (rolling_revenue_{w}d + 1e-5) AS trend_revenue_{w}d" for w in FE.WINDOWS]
    return S.FACTS + f""",
d0 AS (SELECT date, {MEASURE_SUMS} FROM facts GROUP BY date),
d1 AS (
  SELECT *, month(date) AS month, quarter(date) AS quarter, week(date) AS week, isodow(date) - 1 AS day_of_week,
    CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
    CASE WHEN month(date) IN (12, 1, 2) THEN 'WINTER' WHEN month(date) <= 5 THEN 'SPRING'
      WHEN month(date) <= 8 THEN 'SUMMER' ELSE 'FALL' END AS season,
    CASE WHEN month(date) IN (12, 1, 2) THEN 0 WHEN month(date) <= 5 THEN 1
      WHEN month(date) <= 8 THEN 2 ELSE 3 END AS season_encoded,
    least(greatest(CAST(spend AS DOUBLE) / (clicks + 1e-5), 0), 100) AS cpc,
    least(greatest(CAST(spend AS DOUBLE) / (conversions + 1e-5), 0), 1000) AS cpa,
    least(greatest(clicks / (impressions + 1e-5), 0), 1) AS ctr,
    least(greatest(conversions / (clicks + 1e-5), 0), 1) AS conversion_rate,
    CAST(revenue AS DOUBLE) / (CAST(spend AS DOUBLE) + 1e-5) AS roas
  FROM d0
),
d2 AS (SELECT *, CAST(lag(revenue) OVER (ORDER BY date) AS DOUBLE) AS lag_revenue, {', '.join(cols)} FROM d1),
daily AS (SELECT *, {', '.join(later)} FROM d2)"""


ROLL_SPEC = " ".join(
    [f"rolling_{m}_{w}d:{d}" for w in FE.WINDOWS for m, d in
     (("revenue", 6), ("spend", 6), ("roas", 3), ("conversion_rate", 6))]
    + [f"moving_std_{m}_{w}d:{d}" for w in FE.WINDOWS for m, d in
       (("revenue", 2), ("spend", 2), ("roas", 3))]
    + [f"variance_revenue_{w}d:1 trend_revenue_{w}d:6" for w in FE.WINDOWS])
DAILY_SPEC = ("date:d spend:4 revenue:4 clicks:1 impressions:1 conversions:1 month:i quarter:i week:i "
              "day_of_week:i is_weekend:i season:s season_encoded:i cpc:6 cpa:6 ctr:6 "
              "conversion_rate:6 roas:6 " + ROLL_SPEC)


def _scaled(df: DataFrame) -> DataFrame:
    """Variances in millions, so that the compared digits are those that are meant."""
    return df.withColumns({f"variance_revenue_{w}d": F.col(f"variance_revenue_{w}d") / 1e6
                           for w in FE.WINDOWS})


@query("daily_features", DAILY_SPEC, _roll_sql(), "daily")
def _(spark, sf):
    """Calendar, ratios and lagged rolling features of each day."""
    return _scaled(FE.daily_features(cube(spark, sf)))


@query("last_known_features", ROLL_SPEC, _roll_sql() + """,
result AS (SELECT * FROM daily ORDER BY date DESC LIMIT 1)""")
def _(spark, sf):
    return _scaled(FE.last_known(FE.daily_features(cube(spark, sf))))


CHANNEL_DAY = S.FACTS + f""", channel_day AS (
  SELECT *, CAST(spend AS DOUBLE) / (total_daily_spend + 1e-5) AS spend_share,
    CAST(revenue AS DOUBLE) / (total_daily_revenue + 1e-5) AS revenue_share,
    CAST(revenue AS DOUBLE) / (CAST(spend AS DOUBLE) + 1e-5) AS roas,
    CAST(spend AS DOUBLE) / (clicks + 1e-5) AS cpc, clicks / (impressions + 1e-5) AS ctr
  FROM (SELECT c.*, CAST(t.s AS DOUBLE) AS total_daily_spend, CAST(t.r AS DOUBLE) AS total_daily_revenue
    FROM (SELECT date, channel, {MEASURE_SUMS} FROM facts GROUP BY date, channel) c
    JOIN (SELECT date, sum(spend) AS s, sum(revenue) AS r FROM facts GROUP BY date) t USING (date)))"""


@query("channel_features", "date:d channel:s spend:4 revenue:4 clicks:1 impressions:1 conversions:1 "
       "total_daily_spend:4 total_daily_revenue:4 spend_share:6 revenue_share:6 roas:6 cpc:6 ctr:6",
       CHANNEL_DAY, "channel_day")
def _(spark, sf):
    """Channel-day sums with the day's totals attached and the shares."""
    return FE.channel_features(cube(spark, sf))


@query("campaign_features", ROW_SPEC + " roas:6 cpc:6 ctr:6 cpa:6", S.FACTS + """, result AS (
  SELECT *, CAST(revenue AS DOUBLE) / (CAST(spend AS DOUBLE) + 1e-5) AS roas,
    CAST(spend AS DOUBLE) / (clicks + 1e-5) AS cpc, clicks / (impressions + 1e-5) AS ctr,
    CAST(spend AS DOUBLE) / (conversions + 1e-5) AS cpa FROM facts)""")
def _(spark, sf):
    return FE.campaign_features(campaign_facts(spark, sf))


@query("enrich_facts", ROW_SPEC + " season:s rolling_revenue_7d:6 moving_std_spend_30d:2 trend_revenue_14d:6",
       _roll_sql() + """, result AS (
  SELECT f.*, d.season, d.rolling_revenue_7d, d.moving_std_spend_30d, d.trend_revenue_14d
  FROM facts f LEFT JOIN daily d USING (date))""")
def _(spark, sf):
    facts = campaign_facts(spark, sf)
    return FE.enrich_facts(facts, FE.daily_features(E.daily_cube(facts)))


# Entities.

@query("entity_daily", "dimension_type:s dimension_value:s date:d revenue:4 spend:4", S.SERIES, "series")
def _(spark, sf):
    """All four levels in one grouping-sets pass."""
    return E.entity_daily(cube(spark, sf))


@query("dimension_filter", "dimension_value:s date:d revenue:4 spend:4", S.SERIES + """, result AS (
  SELECT * FROM series WHERE dimension_type = 'CampaignType')""")
def _(spark, sf):
    return E.at_level(E.entity_daily(cube(spark, sf)), P.CAMPAIGN_TYPE)


@query("half_open_date_filter", "channel:s days:i revenue:4", S.FACTS + """, result AS (
  SELECT channel, count(DISTINCT date) AS days, sum(revenue) AS revenue FROM facts
  WHERE date >= DATE '1998-03-01' AND date < DATE '1998-05-30' GROUP BY channel)""")
def _(spark, sf):
    rows = E.half_open(campaign_facts(spark, sf), "1998-03-01", "1998-05-30")
    return (rows.groupBy("channel", "date").agg(F.sum("revenue").alias("revenue"))
            .groupBy("channel").agg(F.count("*").alias("days"), F.sum("revenue").alias("revenue")))


@query("last_n_rows", "dimension_type:s dimension_value:s date:d age:i revenue:4", S.SERIES + """,
result AS (SELECT *, row_number() OVER (PARTITION BY dimension_type, dimension_value ORDER BY date DESC) AS age
  FROM series QUALIFY age <= 30)""")
def _(spark, sf):
    return E.last_rows(E.entity_daily(cube(spark, sf)), 30)


@query("campaign_channel_share", "campaign_name:s channel:s channel_share:8",
       ",".join([S.FACTS, S.campaign_map()]), "cmap")
def _(spark, sf):
    """Main channel of each campaign and its share of that channel."""
    return E.campaign_channels(cube(spark, sf))


@query("fallback_scale", "dimension_type:s scale:8", S.SERIES + """,
tot AS (SELECT dimension_type, dimension_value, CAST(sum(CAST(revenue AS DECIMAL(28,6))) AS DOUBLE) AS r
  FROM series WHERE dimension_type <> 'Overall' GROUP BY ALL),
result AS (SELECT dimension_type, median(r / t) AS scale FROM tot JOIN (
  SELECT dimension_type, CAST(sum(CAST(r AS DECIMAL(28,6))) AS DOUBLE) AS t FROM tot GROUP BY ALL) USING (dimension_type)
  GROUP BY dimension_type)""")
def _(spark, sf):
    return E.fallback_scale(E.entity_revenue(E.entity_daily(cube(spark, sf))))


@query("rank_by_revenue", "campaign_id:s revenue:4 position:i", S.FACTS + """, result AS (
  SELECT campaign_id, CAST(sum(revenue) AS DOUBLE) AS revenue,
    row_number() OVER (ORDER BY sum(revenue) DESC, campaign_id) AS position FROM facts GROUP BY campaign_id)""")
def _(spark, sf):
    """Every campaign id's place by revenue, without a one-task window."""
    g = campaign_facts(spark, sf).groupBy("campaign_id").agg(
        F.sum("revenue").cast("double").alias("revenue"))
    return E.rank_by_revenue(materialize(g, "revenue"), "campaign_id")


@query("top_campaigns", "campaign_name:s revenue:4", S.FACTS + """, result AS (
  SELECT campaign_name, CAST(sum(revenue) AS DOUBLE) AS revenue FROM facts GROUP BY campaign_name
  ORDER BY revenue DESC, campaign_name LIMIT 10)""")
def _(spark, sf):
    return E.top_campaigns(cube(spark, sf))


@query("distinct_dimensions", "dimension_type:s dimension_value:s", S.FACTS + """, result AS (
  SELECT DISTINCT 'Channel' AS dimension_type, channel AS dimension_value FROM facts
  UNION ALL SELECT DISTINCT 'CampaignType', campaign_type FROM facts
  UNION ALL SELECT DISTINCT 'Campaign', campaign_name FROM facts)""")
def _(spark, sf):
    return E.distinct_dimensions(cube(spark, sf))


@query("sort_fact", "date:d channel:s campaign_type:s campaign_name:s revenue:4", S.FACTS + """, result AS (
  SELECT date, channel, campaign_type, campaign_name, sum(revenue) AS revenue FROM facts GROUP BY ALL)""")
def _(spark, sf):
    return cube(spark, sf).orderBy("date", "channel")


@query("quantile_cases", "channel:s worst_case:4 expected_case:4 best_case:4", S.SERIES + """, result AS (
  SELECT dimension_value AS channel, quantile_cont(revenue, 0.1) AS worst_case,
    quantile_cont(revenue, 0.5) AS expected_case, quantile_cont(revenue, 0.9) AS best_case
  FROM series WHERE dimension_type = 'Channel' GROUP BY ALL)""")
def _(spark, sf):
    rows = E.at_level(E.entity_daily(cube(spark, sf)), P.CHANNEL)
    return quantile_cases(rows.withColumnRenamed("dimension_value", "channel"), "revenue", ["channel"])


@query("equal_width_histogram", "channel:s bin:i bin_min:4 bin_max:4 bin_center:4 frequency:i", S.FACTS + """,
e AS (SELECT channel, CAST(min(revenue) AS DOUBLE) AS lo, CAST(max(revenue) AS DOUBLE) AS hi FROM facts GROUP BY channel),
b AS (SELECT channel, least(floor((CAST(revenue AS DOUBLE) - lo) / (hi - lo) * 25), 24) AS bin, count(*) AS n
  FROM facts JOIN e USING (channel) GROUP BY ALL),
result AS (SELECT channel, r.bin, lo + (hi - lo) / 25 * r.bin AS bin_min, lo + (hi - lo) / 25 * (r.bin + 1) AS bin_max,
  lo + (hi - lo) / 25 * (r.bin + 0.5) AS bin_center, coalesce(n, 0) AS frequency
  FROM e CROSS JOIN (SELECT range AS bin FROM range(0, 25)) r LEFT JOIN b USING (channel, bin))""")
def _(spark, sf):
    """Over every fact row, by channel."""
    return equal_width_histogram(campaign_facts(spark, sf), "revenue", 25, ["channel"])


# Text.

@query("tag_intent", "conv_id:i turn:i intent:s", """
t AS (SELECT conv_id, turn, lower(text) AS q FROM conversations),
result AS (SELECT conv_id, turn, CASE
  WHEN regexp_matches(q, 'why|reason|cause|explain') AND regexp_matches(q,
    'decrease|decreasing|drop|down|soft|decline|lower|fell|falling|worse|underperform') THEN 'revenue_drop'
  WHEN regexp_matches(q, 'which channel|best channel|top channel|top driver|most growth|highest roas|performing channel|leading channel') THEN 'best_channel'
  WHEN regexp_matches(q, 'meta|facebook') AND regexp_matches(q, 'increase|scale|raise|boost|more|spend|budget') THEN 'meta_scale'
  WHEN contains(q, 'google') AND regexp_matches(q, 'increase|scale|performance|roas|spend|budget|how') THEN 'google'
  WHEN regexp_matches(q, 'bing|microsoft') THEN 'bing'
  WHEN regexp_matches(q, 'forecast|predict|expect|future|30 day|60 day|90 day|30-day|60-day|90-day|next month|next quarter|projection|outlook|revenue next') THEN 'forecast'
  WHEN regexp_matches(q, 'budget|allocat|optimiz|how much should|invest|distribute|split|recommend') THEN 'budget'
  WHEN regexp_matches(q, 'roas|return on ad|efficiency') THEN 'roas'
  WHEN regexp_matches(q, 'risk|concern|worry|volatile|uncertainty|danger') THEN 'risk'
  WHEN regexp_matches(q, 'campaign type|pmax|performance max|remarketing|branded|non-brand|search campaign|social campaign') THEN 'campaign_type'
  ELSE 'general' END AS intent FROM t)""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tag_intent("text").alias("intent"))


@query("strip_markdown")
def _(spark, sf):
    """Whole documents; the rules need lookaround, which the checking SQL has not."""
    return table(spark, sf, "documents").select("doc_id", strip_markdown("text").alias("plain"))
