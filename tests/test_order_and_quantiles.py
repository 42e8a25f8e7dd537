import numpy as np
import pytest
from pyspark.sql import functions as F

from roaskit.operators.ordered import running_totals
from roaskit.operators.quantiles import count_over_percentile, equal_width_histogram, exact_percentile


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.99, 1.0])
def test_percentile_is_exact_with_a_hot_value(spark, q):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.zeros(4000), rng.normal(0, 5, 7919), np.round(rng.uniform(0, 3, 500), 1)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(7)
    assert exact_percentile(df, "v", q).first()[0] == pytest.approx(np.quantile(v, q), abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_percentile_of_small_groups(spark, n):
    rng = np.random.default_rng(n)
    data = {k: rng.normal(k, 1, n + k) for k in range(3)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k int, v double")
    got = {r.k: r.percentile for r in exact_percentile(df, "v", 0.99, ["k"]).collect()}
    for k, xs in data.items():
        assert got[k] == pytest.approx(np.quantile(xs, 0.99), abs=1e-12)


def test_histogram_is_numpys(spark):
    v = np.random.default_rng(1).normal(10, 3, 2000)
    counts, edges = np.histogram(v, 25)
    rows = equal_width_histogram(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", 25).orderBy("bin").collect()
    assert [r.frequency for r in rows] == counts.tolist()
    assert [r.bin_min for r in rows] == pytest.approx(edges[:-1].tolist())
    one = equal_width_histogram(spark.createDataFrame([(5.0,)] * 9, "v double"), "v", 4).collect()
    assert sum(r.frequency for r in one) == 9 and len(one) == 4


@pytest.mark.parametrize("ranges", [1, 2, 16, 500])
def test_running_totals_over_ties(spark, ranges):
    rng = np.random.default_rng(5)
    value = np.where(rng.uniform(size=900) < 0.4, 7.0, rng.integers(0, 50, 900).astype(float))
    rows = [(f"n{i:04d}", float(v), i % 11) for i, v in enumerate(value)]
    df = spark.createDataFrame(rows, "name string, v double, w long").repartition(5)
    got = running_totals(df, [-F.col("v"), F.col("name")], {"cum": "w"}, "pos", ranges).orderBy("pos").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r.name for r in got] == [r[0] for r in want]
    assert [r.pos for r in got] == list(range(1, 901))
    assert [r.cum for r in got] == np.cumsum([r[2] for r in want]).tolist()


@pytest.mark.parametrize("n", [1, 3, 5000])
@pytest.mark.parametrize("q, factor", [(0.99, 3.0), (0.5, 1.0), (0.9, 0.55), (0.0, 2.0), (1.0, 1.0), (0.99, 0.01)])
def test_count_over_a_percentile(spark, n, q, factor):
    rng = np.random.default_rng(n)
    values = np.round(rng.exponential(100.0, n), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert count_over_percentile(df, "v", q, factor).first().above == int((values > np.quantile(values, q) * factor).sum())
