"""Tables behind the executive summary: trends, opportunities, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.attach import attach, scalar_of
from roaskit.functions.scalars import (clamp, compact_money_text, guarded_ratio, millions_text,
                                       money_text, times_text)


def channel_efficiency(cube: DataFrame) -> DataFrame:
    """channel, spend, revenue, roas, spend_share, revenue_share_pct."""
    g = cube.groupBy("channel").agg(F.sum("spend").cast("double").alias("spend"),
                                    F.sum("revenue").cast("double").alias("revenue"))
    total = g.agg(F.sum("spend").alias("_s"), F.sum("revenue").alias("_r"))
    return attach(g, total).select(
        "channel", "spend", "revenue", guarded_ratio("revenue", "spend").alias("roas"),
        guarded_ratio("spend", "_s").alias("spend_share"),
        F.bround(F.col("revenue") / F.col("_r") * 100.0, 1).alias("revenue_share_pct"))


def campaign_type_totals(cube: DataFrame) -> DataFrame:
    g = cube.groupBy("campaign_type").agg(F.sum("revenue").cast("double").alias("revenue"),
                                          F.sum("spend").cast("double").alias("spend"))
    return g.withColumn("roas", guarded_ratio("revenue", "spend"))


def leaders(channels: DataFrame) -> DataFrame:
    """One row: channels with most and least revenue and with the best roas."""
    def first(c: str, falling: bool) -> Column:
        v = -F.col(c) if falling else F.col(c)
        return F.min(F.struct(v.alias("v"), "channel"))["channel"]

    return channels.agg(first("revenue", True).alias("top_channel"),
                        first("revenue", False).alias("low_channel"),
                        first("roas", True).alias("top_roas_channel"))


def _windows(last: Column) -> tuple[Column, Column]:
    """Recent: from 30 days before the last date on, 31 dates. Prior: the 30 before."""
    cut, start = F.date_sub(last, 30), F.date_sub(last, 60)
    d = F.col("date")
    return d >= cut, (d >= start) & (d < cut)


def channel_periods(cube: DataFrame) -> DataFrame:
    """channel, and recent / prior sums of revenue, spend and impressions.

    One conditional aggregation over channel-day rows; the last date is a constant.
    """
    rows = cube.groupBy("date", "channel").agg(
        *[F.sum(m).alias(m) for m in ("revenue", "spend", "impressions")])
    last = cube.agg(F.max("date").alias("_last"))
    recent, prior = _windows(F.col("_last"))
    aggs = []
    for m in ("revenue", "spend", "impressions"):
        for tag, cond in (("recent", recent), ("prior", prior)):
            aggs.append(F.coalesce(F.sum(F.when(cond, F.col(m))).cast("double"), F.lit(0.0))
                        .alias(f"{m}_{tag}"))
    return attach(rows, last).groupBy("channel").agg(*aggs)


def period_over_period(periods: DataFrame) -> DataFrame:
    """One row: the portfolio's recent and prior revenue, spend, roas and changes."""
    s = periods.agg(*[F.sum(f"{m}_{t}").alias(f"{m}_{t}")
                      for m in ("revenue", "spend") for t in ("recent", "prior")])
    s = s.withColumns({f"roas_{t}": guarded_ratio(f"revenue_{t}", f"spend_{t}")
                       for t in ("recent", "prior")})
    return s.withColumns({f"{m}_delta_pct": (F.col(f"{m}_recent") - F.col(f"{m}_prior"))
                          / (F.col(f"{m}_prior") + P.EPS) * 100.0 for m in ("revenue", "roas")})


def channel_trends(periods: DataFrame) -> DataFrame:
    """Each channel's recent against prior revenue, roas and cost per thousand shown;
    `role` marks the declining channel and the stable one."""
    rows = periods
    for t in ("recent", "prior"):
        rows = rows.withColumns({
            f"roas_{t}": guarded_ratio(f"revenue_{t}", f"spend_{t}"),
            f"cpm_{t}": F.when(F.col(f"impressions_{t}") > 0,
                               F.try_divide(f"spend_{t}", f"impressions_{t}") * 1000.0)})
    delta = F.when(F.col("revenue_prior") > 0, (F.col("revenue_recent") - F.col("revenue_prior"))
                   / (F.col("revenue_prior") + P.EPS) * 100.0).otherwise(F.lit(0.0))
    rows = rows.withColumn("revenue_delta_pct", delta)
    down = rows.filter("revenue_prior > 0").agg(
        F.min(F.struct(F.col("revenue_delta_pct").alias("v"), "channel"))["channel"].alias("_down"))
    rows = attach(rows, down)
    firm = rows.filter(F.col("_down").isNull() | (F.col("channel") != F.col("_down"))).agg(
        F.min(F.struct((-F.col("roas_recent")).alias("v"), "channel"))["channel"].alias("_firm"))
    rows = attach(rows, firm)
    return rows.select(
        "channel", *[f"{c}_{t}" for c in ("revenue", "roas", "cpm") for t in ("recent", "prior")],
        "revenue_delta_pct",
        F.when(F.col("channel") == F.col("_down"), "declining")
        .when(F.col("channel") == F.col("_firm"), "stable").otherwise("other").alias("role"))


def anchor_and_momentum(channels: DataFrame, periods: DataFrame) -> DataFrame:
    """One row: the channel with the best roas, and of the others the one whose
    spend grew most; alone it is both."""
    anchor = channels.agg(F.min(F.struct((-F.col("roas")).alias("v"), "channel")).alias("a")).select(
        F.col("a.channel").alias("efficiency_anchor"), (-F.col("a.v")).alias("anchor_roas"))
    rows = attach(periods, anchor, "efficiency_anchor").filter("channel <> efficiency_anchor")
    momentum = F.col("spend_recent") / (F.col("spend_prior") + P.EPS)
    driver = rows.agg(F.min(F.struct((-momentum).alias("v"), "channel"))["channel"].alias("_m"))
    return attach(anchor, driver).select(
        "efficiency_anchor", "anchor_roas",
        F.coalesce("_m", "efficiency_anchor").alias("momentum_driver"))


def growth_opportunities(periods: DataFrame) -> DataFrame:
    """channel, title, tag, insight: one row for each channel there is."""
    ch, now, was = F.col("channel"), F.col("spend_recent"), F.col("spend_prior")
    roas_now = guarded_ratio("revenue_recent", "spend_recent")
    roas_was = guarded_ratio("revenue_prior", "spend_prior")
    meta, google = ch == "Meta Ads", ch == "Google Ads"
    up = F.when(meta, now > was * 1.05).otherwise((was > 0) & (now > was * 1.05))
    title = (F.when(meta & up, "Meta Ads Scale Acceleration")
             .when(meta, "Meta Acquisition Untapped Scale")
             .when(google, "Google Search High-Intent Pacing")
             .when(up, F.concat(ch, F.lit(" Scale Acceleration")))
             .otherwise(F.concat(ch, F.lit(" Untapped Scale"))))
    tag = (F.when(meta & up, "Social Scale").when(meta, "Prospecting")
           .when(google, "Search Bedrock").when(up, "Momentum").otherwise("Prospecting"))
    text = (F.when(meta & up, "Meta spend is growing and should bring added revenue: test new creatives.")
            .when(meta, "Meta spend has not grown: try 15% more on remarketing.")
            .when(google & (roas_now >= roas_was * 0.97),
                  "Google holds its return at this spend: use the room left under the budget caps.")
            .when(google, F.format_string(
                "Google ROAS went from %.2fx to %.2fx: cap bids on weaker terms first.",
                roas_was, roas_now))
            .when(up, F.format_string("%s spend is up %.0f%% on the prior 30 days: room to test more.",
                                      ch, (F.try_divide(now, was) - 1.0) * 100.0))
            .otherwise(F.format_string("%s spend has been flat for 60 days: a candidate for a test.", ch)))
    return periods.select("channel", title.alias("title"), tag.alias("tag"), text.alias("insight"))


def risk_assessment(pop: DataFrame, risk: DataFrame) -> DataFrame:
    """Two rows: on the portfolio's return, and on its variance."""
    rows = attach(pop, risk, "risk_score", "risk_classification")
    soft = F.col("roas_recent") < F.col("roas_prior") * 0.95
    high = F.col("risk_score") > 50
    cells = F.array(
        F.struct(F.lit(1).alias("position"),
                 F.when(soft, "ROAS Efficiency Compression").otherwise("Robust Profitability Trends")
                 .alias("title"),
                 F.when(soft, "High").otherwise("Low").alias("severity"),
                 F.when(soft, F.format_string("ROAS fell from %.2fx to %.2fx in 30 days: cap bids.",
                                              "roas_prior", "roas_recent"))
                 .otherwise(F.format_string("ROAS held or rose, at %.2fx.", "roas_recent"))
                 .alias("insight")),
        F.struct(F.lit(2).alias("position"),
                 F.when(high, "Elevated Portfolio Variance")
                 .otherwise("Low Volatility Forecast Confidence").alias("title"),
                 F.when(high, "High").otherwise("Low").alias("severity"),
                 F.when(high, F.lit("Past variance is high: read the forecast with care."))
                 .otherwise(F.concat(F.lit("The portfolio is classed "), "risk_classification",
                                     F.lit(": intervals are narrow."))).alias("insight")))
    return rows.select(F.explode(cells).alias("c")).select("c.*")


def budget_recommendations(channels: DataFrame) -> DataFrame:
    """channel, roas, gap_pct against the portfolio, magnitude, action, rationale."""
    total = channels.agg(F.sum("revenue").alias("_r"), F.sum("spend").alias("_s"))
    rows = attach(channels, total).withColumn("_all", guarded_ratio("_r", "_s"))
    gap = (F.col("roas") - F.col("_all")) / (F.col("_all") + P.EPS) * 100.0
    rows = rows.withColumn("gap_pct", gap).withColumn(
        "magnitude", clamp(F.bround(F.abs("gap_pct") * 0.6, 0), 5.0, 30.0).cast("int"))
    up, down = F.col("gap_pct") > 10, F.col("gap_pct") < -10
    action = (F.when(up, F.format_string("Increase Spend (+%d%%)", "magnitude"))
              .when(down, F.format_string("Re-allocate (-%d%%)", "magnitude"))
              .otherwise("Maintain / Optimize Pacing"))
    side = F.when(up, "above").when(down, "below").otherwise("close to")
    text = F.format_string("%s returns %.2fx, %s the blended %.2fx.", "channel", "roas", side, "_all")
    return rows.select("channel", "roas", "gap_pct", "magnitude", action.alias("action"),
                       text.alias("rationale")).orderBy(F.col("roas").desc(), "channel")


def executive_summary(channels: DataFrame, anchors: DataFrame, revenue_90d: DataFrame) -> DataFrame:
    """One sentence. `revenue_90d` is a one-row table with `p50`."""
    total = channels.agg(F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"))
    rows = attach(attach(total, anchors), revenue_90d, "p50")
    return rows.select(F.concat(
        millions_text("spend"), F.lit(" of spend brought "), millions_text("revenue"),
        F.lit(" of revenue ("), times_text(guarded_ratio("revenue", "spend")),
        F.lit(" ROAS). The next 90 days are expected at "), millions_text("p50"), F.lit(". "),
        F.col("efficiency_anchor"), F.lit(" is the most efficient channel at "),
        times_text("anchor_roas"), F.lit("; "), F.col("momentum_driver"),
        F.lit(" has the strongest spend momentum.")).alias("executive_summary"))


def budget_shift_note(channels: DataFrame) -> DataFrame:
    """One row: raise the channel with the best roas by 15 %, trim the worst by 10 %."""
    total = channels.agg(F.sum("revenue").alias("_r"), F.sum("spend").alias("_s"))
    rows = attach(channels, total)
    order = F.struct((-F.col("roas")).alias("k"), "channel")
    text = F.struct((-F.col("roas")).alias("k"), "channel", F.format_string(
        "%s %.1f%%", "channel", F.col("spend") / (F.col("_s") + P.EPS) * 100.0).alias("t"))
    g = rows.agg(
        F.count("*").alias("channels"), F.min(order)["channel"].alias("best_channel"),
        F.max(order)["channel"].alias("worst_channel"), F.max("roas").alias("_best"),
        F.max(guarded_ratio("_r", "_s")).alias("_all"),
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(text)), lambda s: s["t"]))
        .alias("spend_shares"))
    several = F.col("channels") >= 2
    return g.select(
        "channels", "best_channel", F.when(several, F.col("worst_channel")).alias("worst_channel"),
        "spend_shares",
        F.when(several, (F.col("_best") - F.col("_all")) * 0.15).otherwise(F.lit(0.0)).alias("roas_gain"))


def last_spend_by_type(cube: DataFrame) -> DataFrame:
    """campaign_type, last_spend_date, days_since_last_spend, status."""
    rows = cube.groupBy("campaign_type").agg(
        F.max(F.when(F.col("spend") > 0, F.col("date"))).alias("last_spend_date"))
    last = cube.agg(F.max("date").alias("_last"))
    days = F.datediff("_last", "last_spend_date")
    return attach(rows, last).select(
        "campaign_type", "last_spend_date", days.alias("days_since_last_spend"),
        F.when(days.isNull(), "no_spend_on_record").when(days <= 30, "active")
        .otherwise("dormant").alias("status"))


def level_breakdown(predictions: DataFrame, level: str, name: str, period: str = "90_days"
                    ) -> DataFrame:
    """name, revenue_p50, share_pct, roas, interval_width_pct of one level and horizon."""
    rows = predictions.filter((F.col("dimension_type") == level)
                              & (F.col("forecast_period") == period))

    def pick(metric: str, q: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(q)))

    g = rows.groupBy(F.col("dimension_value").alias(name)).agg(
        pick("Revenue", "p50").alias("revenue_p50"), pick("ROAS", "p50").alias("roas"),
        pick("ROAS", "p10").alias("_lo"), pick("ROAS", "p90").alias("_hi"))
    total = g.agg(F.sum(F.col("revenue_p50").cast("decimal(28,2)")).cast("double").alias("_t"))
    share = F.col("revenue_p50") / F.when(F.col("_t") == 0, F.lit(1.0)).otherwise(F.col("_t"))
    width = F.when(F.col("roas") > 0, (F.col("_hi") - F.col("_lo")) / F.col("roas") * 100.0)
    return attach(g, total).select(
        name, "revenue_p50", F.bround(share * 100.0, 1).alias("share_pct"), "roas",
        F.bround(F.coalesce(width, F.lit(0.0)), 1).alias("interval_width_pct"))


def channel_breakdown(predictions: DataFrame) -> DataFrame:
    return level_breakdown(predictions, P.CHANNEL, "channel")


def campaign_type_breakdown(predictions: DataFrame, activity: DataFrame) -> DataFrame:
    rows = level_breakdown(predictions, P.CAMPAIGN_TYPE, "campaign_type")
    return rows.join(activity, "campaign_type", "left").select(
        *rows.columns, F.coalesce("status", F.lit("no_spend_on_record")).alias("status"),
        "days_since_last_spend")


def causal_summary(channels: DataFrame, types: DataFrame, overall: DataFrame) -> DataFrame:
    """One sentence out of the breakdowns: lead channel, widest interval, lead type.

    `overall` is one row with revenue_p50 and roas_p50.
    """
    def lead(df: DataFrame, order: str, name: str, cols: tuple[str, ...], tag: str) -> DataFrame:
        s = F.min(F.struct((-F.col(order)).alias("v"), name, *cols))
        return df.agg(s.alias("s")).select(*[F.col(f"s.{c}").alias(f"{tag}_{c}")
                                             for c in (name, *cols)])

    rows = attach(overall, lead(channels, "revenue_p50", "channel", ("share_pct", "roas"), "top"))
    rows = attach(rows, lead(channels, "interval_width_pct", "channel", ("interval_width_pct",), "wide"))
    rows = attach(rows, lead(types, "revenue_p50", "campaign_type", ("share_pct", "roas"), "type"))
    text = F.concat(
        compact_money_text("revenue_p50"), F.lit(" is expected over 90 days. "),
        F.col("top_channel"), F.format_string(" brings %.1f%% of channel revenue at ", "top_share_pct"),
        times_text("top_roas"), F.lit(" ROAS. The blended "), times_text("roas_p50"),
        F.lit(" ROAS hangs most on "), F.col("wide_channel"),
        F.format_string(", whose interval spans %.0f%% of its median. ", "wide_interval_width_pct"),
        F.col("type_campaign_type"),
        F.format_string(" is the largest type with %.1f%% at ", "type_share_pct"),
        times_text("type_roas"), F.lit(" ROAS."))
    return rows.select("revenue_p50", "roas_p50", text.alias("causal_summary"))


def answer_context(channels: DataFrame, pop: DataFrame, overall: DataFrame) -> DataFrame:
    """One row, `context`: totals, channels, trends and forecast as JSON."""
    per = F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", F.struct(
        F.bround("spend", 2).alias("spend"), F.bround("revenue", 2).alias("revenue"),
        F.bround("roas", 2).alias("roas"), F.col("revenue_share_pct").alias("share_pct"))))))
    g = channels.agg(F.sum("spend").alias("_s"), F.sum("revenue").alias("_r"), per.alias("_ch"))
    rows = attach(attach(g, pop, "roas_delta_pct", "revenue_delta_pct"), overall)
    return rows.select(F.to_json(F.struct(
        F.bround("_s", 2).alias("total_spend"), F.bround("_r", 2).alias("total_revenue"),
        F.bround(guarded_ratio("_r", "_s"), 2).alias("overall_roas"),
        F.col("_ch").alias("channels"),
        F.bround("revenue_p50", 2).alias("forecast_90d_revenue"),
        F.bround("roas_p50", 2).alias("forecast_90d_roas"),
        F.bround("roas_delta_pct", 2).alias("roas_trend_30d_pct"),
        F.bround("revenue_delta_pct", 2).alias("revenue_trend_30d_pct"))).alias("context"))


def overall_90d(predictions: DataFrame) -> DataFrame:
    """One row: revenue and roas quantiles of the portfolio over 90 days."""
    rows = predictions.filter((F.col("dimension_type") == P.OVERALL)
                              & (F.col("forecast_period") == "90_days"))
    return rows.agg(*[F.max(F.when(F.col("metric") == m, F.col(q))).alias(f"{n}_{q}")
                      for m, n in (("Revenue", "revenue"), ("ROAS", "roas"))
                      for q in ("p10", "p50", "p90")])


def kpi_overview(channels: DataFrame, overall: DataFrame, risk: DataFrame) -> DataFrame:
    """One row of headline figures; `status` columns included."""
    g = channels.agg(F.sum("spend").alias("total_spend"), F.sum("revenue").alias("total_revenue"))
    rows = attach(attach(g, overall), risk, "risk_score", "risk_classification", "quality_score")
    roas = guarded_ratio("total_revenue", "total_spend")
    return rows.select(
        "total_spend", "total_revenue", roas.alias("overall_roas"),
        F.when(roas < 1, "Below breakeven").when(roas < 3, "Positive return")
        .otherwise("Strong return").alias("roas_label"),
        "quality_score", "risk_score", "risk_classification",
        *[f"{n}_{q}" for n in ("revenue", "roas") for q in ("p10", "p50", "p90")])


def _cell(metric: str, c: str) -> Column:
    return F.when(F.col(metric) == "Revenue", money_text(c)).otherwise(times_text(c))


def report_forecasts(predictions: DataFrame, level: str = P.OVERALL, period: str | None = None
                     ) -> DataFrame:
    """Printable forecast rows of a level: texts instead of numbers."""
    rows = predictions.filter(F.col("dimension_type") == level)
    if period:
        rows = rows.filter(F.col("forecast_period") == period)
    return rows.select(
        "dimension_value", F.initcap(F.replace("forecast_period", F.lit("_"), F.lit(" "))).alias("horizon"),
        "metric", *[_cell("metric", q).alias(q) for q in ("p10", "p50", "p90")])


def report_backtest(comparison: DataFrame, segments: DataFrame) -> DataFrame:
    """Printable backtest rows with the coverage of the portfolio's intervals."""
    seg = segments.filter(F.col("dimension_type") == P.OVERALL).select(
        "metric", "forecast_period", "interval_coverage")
    return comparison.join(seg, ["metric", "forecast_period"], "left").select(
        "forecast_period", "metric", F.format_string("%.1f%%", "ensemble_mape").alias("model_mape"),
        F.format_string("%.1f%%", "naive_baseline_mape").alias("naive_mape"),
        F.format_string("%.0f%%", "interval_coverage").alias("coverage"),
        F.concat(F.when(F.col("ensemble_beats_naive_baseline"), "beats").otherwise("trails"),
                 F.format_string(" (%+.1f%%)", "mape_improvement_pct")).alias("result"))


def report_backtest_sentence(comparison: DataFrame) -> DataFrame:
    """metric, sentence: at which horizons the model beats or trails the baseline."""
    mark = F.format_string("%s (%+.1f%%)", F.replace("forecast_period", F.lit("_days"), F.lit("-day")),
                           "mape_improvement_pct")

    def listed(cond: Column) -> Column:
        return F.concat_ws(", ", F.array_sort(F.collect_list(F.when(cond, mark))))

    win = F.col("ensemble_beats_naive_baseline")
    g = comparison.groupBy("metric").agg(listed(win).alias("_b"), listed(~win).alias("_t"),
                                         F.count_if(win).alias("_nb"), F.count("*").alias("_n"))
    return g.select("metric", F.when(F.col("_nb") == F.col("_n"), F.concat(
        "metric", F.lit(" beats the naive baseline at all horizons: "), "_b"))
        .when(F.col("_nb") == 0, F.concat(
            "metric", F.lit(" trails the naive baseline at all horizons: "), "_t"))
        .otherwise(F.concat("metric", F.lit(" beats the naive baseline at "), "_b",
                            F.lit(" and trails it at "), "_t")).alias("sentence"))
