"""Carrying a one-row result to other rows without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roaskit.sources.storage import materialize

#: Rows of a side that is sent to every executor; beyond it the join shuffles both sides.
SMALL_ROWS = 100_000


def scalar_of(one_row: DataFrame, *names: str) -> Column:
    """The named columns of a one-row table as a struct constant (scalar subquery)."""
    return one_row.select(F.struct(*names).alias("_one")).scalar()


def attach(df: DataFrame, one_row: DataFrame, *names: str) -> DataFrame:
    """Every row of `df` with the columns of the one-row table `one_row`.

    It runs as a scalar subquery: the row is computed once and becomes a constant
    in the tasks, so there is neither a cross product nor a shuffle.
    """
    cols = names or tuple(one_row.columns)
    one = scalar_of(one_row, *cols)
    return df.select("*", *[one[c].alias(c) for c in cols])


def small_side(df: DataFrame, label: str, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` written once, and marked for a broadcast if it has no more than `rows` rows.

    So the facts it is joined with stay where they are; a larger side is left to the planner.
    """
    written = materialize(df, label)
    return F.broadcast(written) if written.count() <= rows else written
