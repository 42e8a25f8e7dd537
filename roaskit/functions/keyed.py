"""Small maps by weekday or month, put together from plain aggregates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_of(value: str, k: int) -> Column:
    return F.col(f"_{value}_{k}")


def values_by_key(key: str, value: str, among: Iterable[int]) -> list[Column]:
    """Aggregates: the value of each key, null where a group has none.

    These are numbers, so they are summed up in a hash table; sets and lists of many groups would be sorted.
    """
    return [F.max(F.when(F.col(key) == k, F.col(value))).alias(f"_{value}_{k}") for k in among]


def seen_keys(key: str) -> Column:
    """Aggregate: a bit for each key that a group has."""
    return F.bit_or(F.pow(F.lit(2.0), F.col(key)).cast("int"))


def map_by_key(value: str, among: Iterable[int], seen: Column | None = None, over: Column | None = None) -> Column:
    """Map from key to value, over `over` if given: of the keys in `seen`, else of those with a value."""
    entries = []
    for k in among:
        v = value_of(value, k)
        there = v.isNotNull() if seen is None else seen.bitwiseAND(F.lit(1 << k)) != 0
        entries.append(F.when(there, F.struct(F.lit(k).alias("key"), (v if over is None else v / over).alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))
