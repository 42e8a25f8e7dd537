"""The daily cube and the daily series of every entity at every level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.operators.ordered import running_totals
from roaskit.operators.quantiles import exact_percentile

MEASURES = ("spend", "revenue", "clicks", "impressions", "conversions")
ENTITY = ["dimension_type", "dimension_value"]
CUBE_KEYS = ("date", "channel", "campaign_type", "campaign_name")


def daily_cube(facts: DataFrame) -> DataFrame:
    """Facts summed by date, channel, type and campaign: the one pass over raw rows.

    Partial sums are made before the shuffle, so a channel or campaign with a third
    of the rows sends no more than its days. `fact_rows` counts what went in.
    """
    return facts.groupBy(*CUBE_KEYS).agg(
        *[F.sum(m).alias(m) for m in MEASURES], F.count("*").alias("fact_rows"))


def entity_daily(cube: DataFrame) -> DataFrame:
    """dimension_type, dimension_value, date, revenue, spend for all four levels.

    One grouping-sets pass over the cube (or facts). grouping_id tells the levels
    apart, so a missing name is not taken for the portfolio.
    """
    d, ch, ty, na = (F.col(c) for c in CUBE_KEYS)
    levels = {7: P.OVERALL, 3: P.CHANNEL, 5: P.CAMPAIGN_TYPE, 6: P.CAMPAIGN}
    gid = F.col("_gid")
    kind = F.lit(None).cast("string")
    for bits, level in levels.items():
        kind = F.when(gid == bits, F.lit(level)).otherwise(kind)
    return (cube.groupingSets([[d], [d, ch], [d, ty], [d, na]], d, ch, ty, na)
            .agg(F.grouping_id().alias("_gid"), F.sum("revenue").cast("double").alias("revenue"),
                 F.sum("spend").cast("double").alias("spend"))
            .select(kind.alias("dimension_type"),
                    F.when(gid == 7, F.lit(P.PORTFOLIO))
                    .otherwise(F.coalesce("channel", "campaign_type", "campaign_name",
                                          F.lit("(none)"))).alias("dimension_value"),
                    "date", "revenue", "spend"))


def at_level(df: DataFrame, level: str) -> DataFrame:
    """Rows of one level; `level` is one of Overall, Channel, CampaignType, Campaign."""
    if level not in P.LEVELS:
        raise ValueError(f"unknown level {level!r}")
    return df.filter(F.col("dimension_type") == level)


def together(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The same rows, those of a series in one partition.

    Whatever groups or windows them by these keys, and by others beside them, moves them no
    more, and plans that begin with the same call share its shuffle.
    """
    return series.select(*(keys or ENTITY), "date", "revenue", "spend").repartition(*[F.col(k) for k in keys or ENTITY])


def last_rows(series: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The last n observed rows of each series (`age` 1 is the newest).

    A series has at most one row a day, so a window holds days, not facts.
    """
    w = Window.partitionBy(*(keys or ENTITY)).orderBy(F.col("date").desc())
    return series.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def campaign_channels(cube: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """[keys,] campaign_name, channel, channel_share.

    A campaign belongs to the channel most of its rows are in (ties: the smaller
    name); the share is its revenue, in all channels, over that channel's revenue.
    """
    keys = list(keys or [])
    pairs = cube.groupBy(*keys, "campaign_name", "channel").agg(
        F.sum("fact_rows").alias("n"), F.sum("revenue").alias("rev"))
    camp = pairs.groupBy(*keys, "campaign_name").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "channel"))["channel"].alias("channel"),
        F.sum("rev").cast("double").alias("_crev"))
    chan = pairs.groupBy(*keys, "channel").agg(F.sum("rev").cast("double").alias("_chrev"))
    return camp.join(chan, [*keys, "channel"]).select(
        *keys, "campaign_name", "channel",
        F.when(F.col("_chrev") > 0, F.col("_crev") / F.col("_chrev")).otherwise(F.lit(0.0))
        .alias("channel_share"))


def entity_revenue(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total revenue and spend of every entity."""
    return series.groupBy(*(keys or ENTITY)).agg(
        F.sum(F.col("revenue").cast("decimal(28,6)")).cast("double").alias("revenue"),
        F.sum(F.col("spend").cast("decimal(28,6)")).cast("double").alias("spend"))


def fallback_scale(totals: DataFrame, folds: list[str] | None = None) -> DataFrame:
    """[folds,] dimension_type, scale: the median revenue share of a level's entities.

    `totals` has one row an entity with its `revenue`.
    """
    level = [*(folds or []), "dimension_type"]
    rows = totals.filter(F.col("dimension_type") != P.OVERALL)
    total = rows.groupBy(*level).agg(
        F.sum(F.col("revenue").cast("decimal(28,6)")).cast("double").alias("_total"))
    share = (rows.join(total, level).filter("_total > 0")
             .withColumn("share", F.col("revenue") / F.col("_total")))
    return exact_percentile(share, "share", 0.5, level, out="scale")


def rank_by_revenue(campaigns: DataFrame, name: str = "campaign_name") -> DataFrame:
    """All campaigns with their position by revenue, ties by name."""
    return running_totals(campaigns, [-F.col("revenue"), F.col(name)], {}, rank="position")


def top_campaigns(cube: DataFrame, n: int = P.TOP_CAMPAIGNS) -> DataFrame:
    """The n campaigns with most revenue: top-n in each task, then of those."""
    return (cube.groupBy("campaign_name").agg(F.sum("revenue").cast("double").alias("revenue"))
            .orderBy(F.col("revenue").desc(), "campaign_name").limit(n))


def distinct_dimensions(cube: DataFrame) -> DataFrame:
    """dimension_type, dimension_value present in the data."""
    parts = [(P.CHANNEL, "channel"), (P.CAMPAIGN_TYPE, "campaign_type"),
             (P.CAMPAIGN, "campaign_name")]
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension_type"),
                               F.col(c).alias("dimension_value")) for k, c in parts])
    return (cube.select("channel", "campaign_type", "campaign_name").distinct()
            .select(F.explode(pairs).alias("p")).select("p.*")
            .filter("dimension_value is not null").distinct())


def half_open(df: DataFrame, start: Column | str, end: Column | str) -> DataFrame:
    """Rows of [start, end)."""
    lo = F.lit(start).cast("date") if isinstance(start, str) else start
    hi = F.lit(end).cast("date") if isinstance(end, str) else end
    return df.filter((F.col("date") >= lo) & (F.col("date") < hi))
