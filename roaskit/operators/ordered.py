"""Ranks and running totals over one global order, without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roaskit.functions.attach import attach


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str],
                   rank: str = "rank", ranges: int | None = None) -> DataFrame:
    """`df` with its 1-based position in `order` and running sums up to it.

    `order` ascends (negate a number to descend) and must be a total order: end it
    with a unique column. The order is cut into ranges at keys picked by their
    hash, which splits runs of equal values too, as the unique column is part of
the key. There are as many ranges as shuffle partitions. Each range is ordered by itself and starts from the totals of the
    ranges before it; only these, one row a range, are summed in one task.
    `df` is read three times: hand in a reduced or materialized table.
    """
    ranges = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    d = df.withColumn("_key", key)
    picks = (d.select("_key", F.xxhash64("_key").alias("_h")).orderBy("_h").limit(ranges - 1)
             .agg(F.array_sort(F.collect_list("_key")).alias("_picks")))
    d = attach(d, picks, "_picks").withColumn("_range", F.size(F.filter(
        "_picks", lambda s: s < F.col("_key")))).drop("_picks")
    totals = d.groupBy("_range").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_s_{o}") for o in sums])
    inside = Window.partitionBy("_range").orderBy("_key")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.join(starts, "_range").select(
        *df.columns,
        (F.row_number().over(inside) + F.col("_n0")).cast("long").alias(rank),
        *[(F.sum(c).over(upto) + F.col(f"_s_{o}")).alias(o) for o, c in sums.items()])
