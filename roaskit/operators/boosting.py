"""Boosted regression trees of many series at once, by histogram sums.

A series (of a fold) with a row a day is one row with arrays, and each member of each series
is one fit, so all folds, entities and members are fitted side by side in one job. A tree
grows level by level: the sums of the residuals by node, feature and bin give every split of
a level together. What is fitted is a row of arrays, and predicting needs no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 64


@dataclass(frozen=True)
class Learner:
    """How a member's trees grow: rounds, depth, step; penalty on leaves, rows a leaf needs, one split for a whole level."""

    rounds: int = 150
    depth: int = 5
    step: float = 0.08
    penalty: float = 1.0
    least_rows: int = 1
    level_split: bool = False


def bin_edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds of a column: between all its values if these are few, else between quantiles."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins), method="lower"))
    return (values[:-1] + values[1:]) / 2


def grow(codes: np.ndarray, counts: np.ndarray, residual: np.ndarray, how: Learner) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree over binned features: feature and bin of each inner node in heap order (bin -1: all rows go left), leaf values, each row's leaf.

    codes: the bin of each row and feature. counts: the bins of each feature.
    """
    rows, features = codes.shape
    width = int(counts.max(initial=1))
    split_feature = np.zeros((1 << how.depth) - 1, np.int64)
    split_bin = np.full((1 << how.depth) - 1, -1, np.int64)
    node = np.zeros(rows, np.int64)
    flat = codes + np.arange(features) * width
    real = np.arange(width)[None] < counts[:, None] - 1   # a split after the last bin parts nothing
    for level in range(how.depth):
        nodes = 1 << level
        at = (node[:, None] * (features * width) + flat).ravel()
        size = nodes * features * width
        total = np.bincount(at, np.repeat(residual, features), size).reshape(nodes, features, width).cumsum(axis=2)
        n = np.bincount(at, minlength=size).reshape(nodes, features, width).cumsum(axis=2)
        all_total, all_n = total[:, :, -1:], n[:, :, -1:]
        other, m = all_total - total, all_n - n
        weigh = lambda s, k: s**2 / np.maximum(k + how.penalty, 1e-12)  # noqa: E731 - what rows with this sum gain as a leaf
        gain = weigh(total, n) + weigh(other, m) - weigh(all_total, all_n)
        allowed = real[None] & (n >= how.least_rows) & (m >= how.least_rows)
        gain = np.where(allowed, gain, 0.0 if how.level_split else -1.0)
        if how.level_split:
            gain = np.broadcast_to(gain.sum(axis=0), gain.shape)
        best = gain.reshape(nodes, -1).argmax(axis=1)
        good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9 * max(1.0, float((residual**2).sum()))
        here = slice(nodes - 1, 2 * nodes - 1)
        split_feature[here] = np.where(good, best // width, 0)
        split_bin[here] = np.where(good, best % width, -1)
        f, b = split_feature[here][node], split_bin[here][node]
        node = 2 * node + ((b >= 0) & (codes[np.arange(rows), f] > b))
    leaves = 1 << how.depth
    n = np.bincount(node, minlength=leaves)
    value = how.step * np.bincount(node, residual, leaves) / np.maximum(n + how.penalty, 1e-12)
    return split_feature, split_bin, np.where(n > 0, value, 0.0), node


def boosted(x: np.ndarray, y: np.ndarray, how: Learner) -> dict:
    """base, and for all trees one after the other: feature and threshold of the inner nodes, value of the leaves."""
    edges = [bin_edges(x[:, f]) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(y), 0), np.int64)
    counts = np.array([len(e) + 1 for e in edges])
    base = float(y.mean())
    fitted = np.full(len(y), base)
    feature, threshold, value = [], [], []
    for _ in range(how.rounds):
        f, b, leaf, node = grow(codes, counts, y - fitted, how)
        fitted += leaf[node]
        feature.append(f)
        threshold.append(np.array([edges[i][k] if k >= 0 else np.inf for i, k in zip(f, b)]))
        value.append(leaf)
    return {"base": base, "feature": np.concatenate(feature), "threshold": np.concatenate(threshold), "value": np.concatenate(value)}


def predicted(x: np.ndarray, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """The sum of the trees for each row."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    trees = len(value) // leaves
    at = np.zeros((len(x), trees), np.int64)
    start = np.arange(trees) * inner
    for _ in range(depth):
        i = start + at
        at = 2 * at + 1 + (np.take_along_axis(x, feature[i], axis=1) > threshold[i])
    return base + value[at - inner + np.arange(trees) * leaves].sum(axis=1)


MODEL_DDL = "member string, depth int, base double, feature array<int>, threshold array<double>, value array<double>"


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*keys).schema)


def _spread(df: DataFrame, *cols: str) -> DataFrame:
    """Over as many tasks as there are shuffle partitions: these rows are few and each is much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def frames(rows: DataFrame, keys: list[str], features: list[str], extra: list[str]) -> DataFrame:
    """keys, days: one row a series, its days in order as structs of date, x (the features) and the extra columns."""
    day = F.struct("date", F.array(*[F.col(c).cast("double") for c in features]).alias("x"), *extra)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(day)).alias("days"))


def fit_trees(series: DataFrame, keys: list[str], learners: dict[str, tuple[Learner, str, int]]) -> DataFrame:
    """keys and the columns of MODEL_DDL: one row a series and member.

    series: as `frames` makes it. learners: member -> (how, target, how many features it sees, from the first).
    """
    plan = {name: (asdict(how), target, n) for name, (how, target, n) in learners.items()}
    key_ddl = _ddl(series, keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                how, target, n = plan[batch.column("member")[i].as_py()]
                days = batch.column("days")[i].values
                x = np.array(days.field("x").to_pylist(), float).reshape(len(days), -1)[:, :n]
                y = np.asarray(days.field(target).cast(pa.float64()).fill_null(0.0))
                got = boosted(x, y, Learner(**how))
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*[one.column(k) for k in keys], one.column("member"), pa.array([how["depth"]], pa.int32()), pa.array([got["base"]]),
                     pa.array([got["feature"]], pa.list_(pa.int32())), pa.array([got["threshold"]], pa.list_(pa.float64())),
                     pa.array([got["value"]], pa.list_(pa.float64()))],
                    names=[*keys, "member", "depth", "base", "feature", "threshold", "value"])

    jobs = series.withColumn("member", F.explode(F.array(*[F.lit(m) for m in learners])))
    return _spread(jobs, *keys, "member").mapInArrow(task, key_ddl + MODEL_DDL)


def predict_trees(models: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, member, date, value: every member's value on each day of `series` (as `frames` makes it)."""
    key_ddl = _ddl(models, keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                days = batch.column("days")[i].values
                x = np.array(days.field("x").to_pylist(), float).reshape(len(days), -1)
                base, depth = batch.column("base")[i].as_py(), batch.column("depth")[i].as_py()
                feature, threshold, value = (np.asarray(batch.column(c)[i].values) for c in ("feature", "threshold", "value"))
                got = predicted(x, base, feature, threshold, value, depth)
                keep = [pa.array([batch.column(c)[i].as_py()] * len(days), batch.schema.field(c).type) for c in (*keys, "member")]
                yield pa.RecordBatch.from_arrays([*keep, days.field("date"), pa.array(got)], names=[*keys, "member", "date", "value"])

    return _spread(models.join(series, keys), *keys, "member").mapInArrow(task, key_ddl + "member string, date date, value double")
