"""The named queries over the given tables, each with SQL that must agree with it.

A query is a function (spark, sf_dir) -> DataFrame. Its checking SQL is written on
its own, in another dialect; both sides end in the same output shape.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def shape(df: DataFrame, spec: str) -> DataFrame:
    """The columns of `spec`, "name:kind ...": s text, d date as text, i whole number,
    b truth value, or a number of digits to round to."""
    cols = []
    for item in spec.split():
        name, kind = item.split(":")
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "s":
            c = c.cast("string")
        elif kind != "b":
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        cols.append(c.alias(name))
    return df.select(*cols)


def shape_sql(ctes: str, table: str, spec: str) -> str:
    cols = []
    for item in spec.split():
        name, kind = item.split(":")
        if kind == "d":
            c = f"strftime({name}, '%Y-%m-%d')"
        elif kind == "i":
            c = f"CAST({name} AS BIGINT)"
        elif kind == "s":
            c = f"CAST({name} AS VARCHAR)"
        elif kind == "b":
            c = name
        else:
            c = f"round(CAST({name} AS DOUBLE), {kind}) + 0.0"
        cols.append(f"{c} AS {name}")
    return f"WITH RECURSIVE {ctes}\nSELECT {', '.join(cols)}\nFROM {table}"


def query(name: str, spec: str | None = None, ctes: str | None = None, table: str = "result"
          ) -> Callable[[Build], Build]:
    """Registers a query; with `ctes` also its SQL, whose last table is `table`."""
    def register(build: Build) -> Build:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return shape(df, spec) if spec else df
        sql = shape_sql(ctes, table, spec) if ctes else None
        if name in REGISTRY:
            raise ValueError(f"query {name} is there already")
        REGISTRY[name] = Query(name, run, sql)
        return build
    return register
