"""Advertising views over the given star-schema tables.

The tables hold orders, not ads. `campaign_facts` reads a line item as one
campaign-day: the customer's region is the channel, the part's brand the
campaign, its type the campaign type. `raw_export` renders the same rows as
messy text the way ad platforms export them, for the ingest operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str, kind: str = "decimal(18,2)"):
    return F.col(c).cast(kind)


def campaign_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, channel, campaign_id, campaign_name, campaign_type and five measures.

    Orders get their channel first, so line items, by far the largest table, meet
    the whole customer side in one join on the order key; columns are pruned before
    it. That join sorts and merges, as neither side stays small, and is open to
    adaptive skew splitting; the other joins are left to the planner, which
    broadcasts nation, region, part and customer while they are under its threshold
    and sort-merges beyond it. Money is decimal, so totals do not depend on the
    order rows arrive in.
    """
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax")
    channel_of = (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
                  .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
                        F.col("o_custkey") == F.col("c_custkey"))
                  .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"),
                        F.col("c_nationkey") == F.col("n_nationkey"))
                  .join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
                        F.col("n_regionkey") == F.col("r_regionkey"))
                  .select("o_orderkey", "r_name"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    price, disc, tax = (_money("l_extendedprice"), _money("l_discount", "decimal(4,2)"),
                        _money("l_tax", "decimal(4,2)"))
    return (
        line.hint("merge").join(channel_of, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.to_date("l_shipdate").alias("date"),
            F.col("r_name").alias("channel"),
            F.col("l_partkey").cast("string").alias("campaign_id"),
            F.col("p_brand").alias("campaign_name"),
            F.col("p_type").alias("campaign_type"),
            (price * (disc + tax)).cast("decimal(18,4)").alias("spend"),
            (price * (F.lit(1).cast("decimal(1,0)") - disc)).cast("decimal(18,4)").alias("revenue"),
            F.col("l_quantity").alias("clicks"),
            (F.col("l_quantity") * F.col("p_size")).alias("impressions"),
            F.lit(1.0).alias("conversions"),
        )
    )


def raw_export(spark: SparkSession, sf_dir: str, platform: str) -> DataFrame:
    """One platform's rows as text under that platform's header spelling.

    Return flag A plays google, N bing, R meta. The text carries the faults the
    validators look for: dates that do not parse, bad numbers, negative amounts,
    missing names and types, a header that is absent. `_file`, `_block` and `_pos`
    give the order of the rows, in place of a position in a file.
    """
    flag = {"google": "A", "bing": "N", "meta": "R"}[platform]
    line = (table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
            .join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"),
                  F.col("l_partkey") == F.col("p_partkey")))
    price, disc, tax = (_money("l_extendedprice"), _money("l_discount", "decimal(4,2)"),
                        _money("l_tax", "decimal(4,2)"))
    cost = (price * (disc + tax)).cast("decimal(18,4)")
    # A refund day: no tax and the smallest discount turn the cost negative.
    cost = F.when(tax == 0, -cost).otherwise(cost)
    value = (price * (F.lit(1).cast("decimal(1,0)") - disc)).cast("decimal(18,4)")
    value_text = F.when(disc == 0, F.lit("n/a")).otherwise(value.cast("string"))
    day = F.when(F.col("l_quantity") == 1, F.lit("unknown")).otherwise(
        F.date_format("l_shipdate", "yyyy-MM-dd"))
    count = F.col("l_quantity").cast("int").cast("string")
    shown = (F.when(F.col("l_quantity") > 45, F.lit(0))
             .otherwise(F.col("l_quantity") * F.col("p_size")).cast("int").cast("string"))
    kind = (F.when(F.col("p_type") == "PROMO", F.lit("PerformanceMax"))
            .when(F.col("p_type") == "ECONOMY", F.lit(None).cast("string"))
            .when(F.col("p_type") == "LARGE", F.lit("Demand - Gen"))
            .otherwise(F.lower("p_type")))
    name = F.when(F.col("p_size") == 50, F.lit(None).cast("string")).otherwise(F.col("p_brand"))
    ident = F.col("l_partkey").cast("string")
    order = [F.lit(platform).alias("_file"),
             F.floor(F.col("l_orderkey") / 4096).alias("_block"),
             F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
             .alias("_pos")]
    if platform == "google":
        cols = [ident.alias("campaign_id"), day.alias("segments_date"), count.alias("Clicks"),
                F.lit("1").alias("metrics_conversions"),
                (cost * 1000000).cast("decimal(28,0)").cast("string").alias("cost-micros"),
                shown.alias("Impr"), value_text.alias("metrics conversions value"),
                kind.alias("Campaign Type"), name.alias("campaign_name")]
    elif platform == "bing":
        cols = [ident.alias("CampaignId"), day.alias("TimePeriod"),
                cost.cast("string").alias("Spend"), value_text.alias("Value"),
                shown.alias("Impressions"), F.lit("1").alias("Conversions"),
                kind.alias("Type"), name.alias("CampaignName")]
    else:
        cols = [ident.alias("id"), day.alias("Date Start"), cost.cast("string").alias("Cost"),
                value_text.alias("Purchase Value"), count.alias("click"),
                shown.alias("impressions"), name.alias("Campaign")]
    return line.select(*order, *cols)


def event_ad_rows(events: DataFrame) -> DataFrame:
    """The events read as ad rows: views are impressions, clicks cost a tenth of
    their value, purchases convert at their value. Works on streams and tables."""
    is_click = F.col("event_type") == "click"
    is_buy = F.col("event_type") == "purchase"
    money = F.col("value").cast("decimal(18,4)")
    none = F.lit(0).cast("decimal(18,4)")
    return events.filter(F.col("event_type").isin("view", "click", "purchase")).select(
        "event_id", "ts",
        F.element_at(F.array(F.lit("Google Ads"), F.lit("Meta Ads"), F.lit("Bing Ads")),
                     (F.col("user_id") % 3 + 1).cast("int")).alias("channel"),
        F.when(is_click, (money * F.lit(0.1).cast("decimal(2,1)")).cast("decimal(18,4)"))
        .otherwise(none).alias("spend"),
        F.when(is_buy, money).otherwise(none).alias("revenue"),
        is_click.cast("long").alias("clicks"),
        (F.col("event_type") == "view").cast("long").alias("impressions"),
        is_buy.cast("long").alias("conversions"),
    )
