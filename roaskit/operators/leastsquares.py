"""Least squares of many series at once, by normal equations.

A series gives the sums of the outer products of its design rows, made by one grouping with
partial sums before the shuffle; a matrix of 30 by 30 is all that is left of it, and solved.
The design is that of the seasonal member: a straight trend, six weekdays against Monday, and
ten yearly Fourier pairs from a year of history on.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.scalars import as_col
from roaskit.operators.entities import ENTITY

TARGETS = ("revenue", "spend")


def seasonal_terms(date: str | Column, first: str | Column = "first_date", last: str | Column = "last_date") -> Column:
    """The design row of a date of a series observed from `first` to `last`."""
    d, lo, hi = as_col(date), as_col(first), as_col(last)
    since = F.datediff(d, lo).cast("double")
    yearly = F.datediff(hi, lo) >= P.YEARLY_TERM_MIN_DAYS
    terms = [F.lit(1.0), F.datediff(d, hi).cast("double") / F.lit(365.25)]
    terms += [(F.weekday(d) == k).cast("double") for k in range(1, 7)]
    for k in range(1, P.YEARLY_PAIRS + 1):
        angle = since * F.lit(2.0 * math.pi * k / 365.25)
        terms += [F.when(yearly, F.cos(angle)).otherwise(0.0), F.when(yearly, F.sin(angle)).otherwise(0.0)]
    return F.array(*terms)


WIDTH = 8 + 2 * P.YEARLY_PAIRS


def normal_sums(rows: DataFrame, keys: list[str], terms: Column, width: int, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """keys, sums: of x[i] * x[j] for every i <= j, x being the terms and then the targets, in the order of (i, j)."""
    every = width + len(targets)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(every) for j in range(i, every)])
    x = F.concat(terms, F.array(*[F.col(t).cast("double") for t in targets]))
    cells = (rows.select(*keys, x.alias("x")).select(*keys, "x", F.explode(pairs).alias("at"))
             .groupBy(*keys, "at").agg(F.sum(F.get("x", F.col("at.i")) * F.get("x", F.col("at.j"))).alias("s")))
    ordered = F.sort_array(F.collect_list(F.struct("at", "s")))
    return cells.groupBy(*keys).agg(F.transform(ordered, lambda c: c["s"]).alias("sums"))


def solved(sums: DataFrame, width: int, targets: tuple[str, ...] = TARGETS, ridge: float = P.RIDGE) -> DataFrame:
    """`sums` with {target}_beta, the coefficients; `ridge` on the diagonal settles what the rows leave open."""
    every = width + len(targets)
    upper = np.triu_indices(every)
    names = [f"{t}_beta" for t in targets]

    @F.pandas_udf("array<array<double>>")
    def solve(packed):
        out = []
        for one in packed:
            m = np.zeros((every, every))
            m[upper] = one
            m += np.triu(m, 1).T
            out.append(np.linalg.solve(m[:width, :width] + ridge * np.eye(width), m[:width, width:]).T.tolist())
        return type(packed)(out)

    got = sums.withColumn("_betas", solve("sums"))
    return got.select(*[c for c in sums.columns if c != "sums"], *[F.get("_betas", F.lit(i)).alias(n) for i, n in enumerate(names)])


def product(x: Column, beta: str | Column) -> Column:
    """The inner product of two arrays."""
    return F.aggregate(F.zip_with(x, as_col(beta), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def fit_seasonal(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, first_date, last_date, revenue_beta, spend_beta, and the population spread of the residuals.

    The series is read three times: for its ends, its sums and its residuals; hand in a
    materialized table. It has a row a day at most, so what is joined is small.
    """
    keys = list(keys or ENTITY)
    ends = series.groupBy(*keys).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    rows = series.join(ends, keys)
    beta = solved(normal_sums(rows, keys, seasonal_terms("date"), WIDTH), WIDTH).join(ends, keys)
    gaps = rows.drop("first_date", "last_date").join(beta, keys).select(
        *keys, *[(F.col(t).cast("double") - product(seasonal_terms("date"), f"{t}_beta")).alias(f"_{t}") for t in TARGETS])
    spread = gaps.groupBy(*keys).agg(*[F.stddev_pop(f"_{t}").alias(f"{t}_std") for t in TARGETS])
    return beta.join(spread, keys)


def seasonal_value(target: str, date: str | Column = "date") -> Column:
    """The member's value on a date, on rows that carry the columns of `fit_seasonal`."""
    return product(seasonal_terms(date), f"{target}_beta")
