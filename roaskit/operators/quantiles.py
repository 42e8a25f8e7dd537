"""Exact quantiles and histograms that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roaskit.functions.attach import attach, small_side
from roaskit.sources.storage import materialize

#: The sketch's rank is off by no more than a row in so many, and the bracket is five times as wide.
ACCURACY, MARGIN = 20000, 5


def _bracketed(df: DataFrame, value: str, q: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the non-null values with the bracket of their group, one row a group with its bracket and rank).

    The bracket, from a sketch, holds the values of the two ranks about q; the first pass.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    room = MARGIN / ACCURACY
    ends = F.percentile_approx("_v", [max(0.0, q - room), min(1.0, q + room)], ACCURACY)
    bounds = rows.groupBy(*keys).agg(ends.alias("_e"), F.count("*").alias("_n")).filter("_n > 0")
    pos = F.lit(q) * (F.col("_n") - 1)
    bounds = bounds.select(*keys, F.get("_e", F.lit(0)).alias("_low"), F.get("_e", F.lit(1)).alias("_high"),
                           F.floor(pos).alias("_k"), (pos - F.floor(pos)).alias("_f"))
    if keys:
        return rows.join(small_side(bounds, "bounds"), keys), bounds
    return attach(rows, bounds, "_low", "_high", "_k", "_f"), bounds


def _percentile_of(cells: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The quantile of each group out of its cells: counts of the values in the bracket (_v), and of all below it (_v null).

    `_prev` and `_next` are the values next to the bracket: a sketch counts ranks from 1 and
    does not interpolate, so either rank may be just there.
    """
    upto = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.filter("not _above").withColumn("_end", F.sum("_c").over(upto))
    placed = placed.withColumn("_start", F.col("_end") - F.col("_c"))
    below = F.sum(F.when(F.col("_v").isNull() & ~F.col("_above"), F.col("_c")))
    behind = cells.groupBy(*keys).agg(F.max("_prev").alias("_prev"), F.min("_next").alias("_next"), below.alias("_below"),
                                      F.max("_k").alias("_k"), F.max("_f").alias("_f"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    found = placed.groupBy(*keys).agg(at(F.col("_k")).alias("_lo"), at(F.col("_k") + 1).alias("_hi"))
    both = found.join(behind, keys) if keys else attach(found, behind, "_prev", "_next", "_below", "_k", "_f")
    lost = F.raise_error(F.lit("the sketch missed the rank by more than its bound"))
    low = F.coalesce("_lo", F.when(F.col("_below") == F.col("_k") + 1, F.col("_prev")), F.when(F.col("_k").isNotNull(), lost.cast("double")))
    return both.select(*keys, (low + F.coalesce(F.when(F.col("_f") > 0, F.col("_f") * (F.coalesce("_hi", "_next") - low)), F.lit(0.0))).alias(out))


def _cells(rows: DataFrame, keys: list[str], kept: Column) -> DataFrame:
    """Counts by value where `kept` or in the bracket, else one count below the bracket and one above; partial sums before the shuffle."""
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    above, below = F.col("_v") > F.col("_high"), F.col("_v") < F.col("_low")
    return rows.groupBy(*keys, F.when(inside | kept, F.col("_v")).alias("_v"), above.alias("_above")).agg(
        F.count("*").alias("_c"), F.max(F.when(below, F.col("_v"))).alias("_prev"), F.min(F.when(above, F.col("_v"))).alias("_next"), F.max("_k").alias("_k"), F.max("_f").alias("_f"))


def exact_percentile(df: DataFrame, value: str, q: float, keys: list[str] | None = None,
                     out: str = "percentile") -> DataFrame:
    """The q-quantile, linearly interpolated, for each group of `keys`; two passes.

    A sketch brackets the asked rank within its error bound; the second pass counts what is
    below the bracket and the distinct values within, and only these are ordered. So the
    result is exact for any data. A value that fills a third of the rows is one counted row.
    """
    keys = list(keys or [])
    rows, _ = _bracketed(df, value, q, keys)
    cells = materialize(_cells(rows, keys, F.lit(False)), "cells")
    return _percentile_of(cells, keys, out)


def count_over_percentile(df: DataFrame, value: str, q: float, factor: float) -> DataFrame:
    """One row, `above`: how many values exceed `factor` (over 0) times the exact q-quantile; two passes.

    Beyond the quantile's bracket the second pass keeps the distinct values between `factor`
    times its ends, as only these depend on where in the bracket the quantile is.
    """
    rows, bounds = _bracketed(df, value, q, [])
    ends = [F.col("_low") * factor, F.col("_high") * factor]
    between = F.col("_v").between(F.least(*ends), F.greatest(*ends))
    far = F.col("_v") > F.greatest(*ends)
    cells = materialize(_cells(rows.withColumn("_far", far), ["_far"], between), "cells")
    # values kept only for the count lie below or above the bracket: they go back to their side
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    merged = (attach(cells, bounds.select("_low", "_high"), "_low", "_high").groupBy(F.when(inside, F.col("_v")).alias("_v"), "_above")
              .agg(F.sum("_c").alias("_c"), F.max("_prev").alias("_prev"), F.min("_next").alias("_next"), F.max("_k").alias("_k"), F.max("_f").alias("_f")))
    limit = _percentile_of(merged, [], "_limit").select((F.col("_limit") * factor).alias("_limit"))
    over = attach(cells, limit, "_limit").agg(F.coalesce(F.sum(F.when(F.col("_far") | (F.col("_v") > F.col("_limit")), F.col("_c"))), F.lit(0)).alias("above"))
    return over


def equal_width_histogram(df: DataFrame, value: str, bins: int, keys: list[str] | None = None
                          ) -> DataFrame:
    """bin, bin_min, bin_max, bin_center, frequency for each group; empty bins stay.

    The last bin holds its right edge. A group of one value gets bins of total
    width 1 around it.
    """
    keys = list(keys or [])
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    edges = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    edges = edges.select(*keys, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                         F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    if keys:
        edges = small_side(edges, "edges")
        placed = rows.join(edges, keys)
    else:
        edges = edges.filter("_lo is not null")
        placed = attach(rows, edges, "_lo", "_hi")
    counts = (placed.withColumn("bin", F.least(
        F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins),
        F.lit(bins - 1)).cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("frequency")))
    grid = edges.select(*keys, "_lo", "_hi",
                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (grid.join(counts, [*keys, "bin"], "left")
            .select(*keys, "bin", (F.col("_lo") + width * F.col("bin")).alias("bin_min"),
                    (F.col("_lo") + width * (F.col("bin") + 1)).alias("bin_max"),
                    (F.col("_lo") + width * (F.col("bin") + 0.5)).alias("bin_center"),
                    F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency")))


def quantile_cases(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """worst_case (p10), expected_case (median), best_case (p90) for each group.

    A group's exact quantiles are held in one task: right for draws, of which an
    entity has a fixed number, and for daily series. Use `exact_percentile` for
    raw rows.
    """
    p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = df.groupBy(*(keys or [])).agg(p.alias("_p"))
    return g.select(*(keys or []), *[F.element_at("_p", i + 1).alias(n) for i, n in enumerate(
        ("worst_case", "expected_case", "best_case"))])
