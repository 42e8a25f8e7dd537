import numpy as np
import pytest

from roaskit.operators import budget as BU

BUDGET = 1_000_000.0
CURVE = "channel string, alpha double, beta double, base_roas double, fit_cv double"


def curves(spark, n, betas=(0.7, 0.85)):
    draw = np.random.default_rng(n)
    return spark.createDataFrame([(f"c{i:04d}", float(20 + 80 * draw.random()), float(draw.uniform(*betas)), 1.0, 0.1) for i in range(n)], CURVE)


def allocated(spark, rows, target, share):
    bounds = {r.channel: r for r in BU.allocation_bounds(rows, BUDGET, share).collect()}
    got = {r.channel: r.allocated_spend for r in BU.allocate_exact(rows, BUDGET, target, share).collect()}
    assert set(got) == set(bounds)
    return bounds, got


@pytest.mark.parametrize("n, share", [(5, 0.01), (120, 0.001), (500, 0.0001)])
def test_equal_marginal_returns_within_the_bounds(spark, n, share):
    """What is needed and enough for the best of concave curves: one multiplier for all that is free."""
    bounds, got = allocated(spark, curves(spark, n), 0.0, share)
    assert sum(got.values()) == pytest.approx(min(BUDGET, sum(b.upper for b in bounds.values())), rel=1e-9)
    free, low, high = [], [], []
    for c, b in bounds.items():
        marginal = b.alpha * b.beta * got[c] ** (b.beta - 1)
        (low if got[c] <= b.lower * (1 + 1e-9) else high if got[c] >= b.upper * (1 - 1e-9) else free).append(marginal)
    assert free and max(free) == pytest.approx(min(free), rel=1e-9)
    assert all(m <= free[0] * (1 + 1e-9) for m in low) and all(m >= free[0] * (1 - 1e-9) for m in high)


def test_closed_form_where_no_bound_is_met(spark):
    rows = curves(spark, 5, (0.6, 0.6 + 1e-12))
    bounds, got = allocated(spark, rows, 0.0, 0.0001)
    weight = {c: b.alpha ** (1 / 0.4) for c, b in bounds.items()}
    want = {c: BUDGET * w / sum(weight.values()) for c, w in weight.items()}
    assert all(b.lower < want[c] < b.upper for c, b in bounds.items())
    assert got == pytest.approx(want, rel=1e-6)


def test_target_that_binds_and_target_out_of_reach(spark):
    rows = curves(spark, 5)
    bounds, got = allocated(spark, rows, 0.0, 0.01)
    b = list(bounds.values())

    def roas(spends):
        return sum(x.alpha * s ** x.beta for x, s in zip(b, spends)) / sum(spends)

    whole = roas([got[x.channel] for x in b])
    tops = [roas([max(x.lower, min(x.upper, (m / (x.alpha * x.beta)) ** (1 / (x.beta - 1)))) for x in b]) for m in np.geomspace(0.01, 100, 20_001)]
    target = (whole + max(tops)) / 2
    _, bound = allocated(spark, rows, target, 0.01)
    assert sum(bound.values()) < BUDGET and roas([bound[x.channel] for x in b]) == pytest.approx(target, rel=1e-9)
    _, peak = allocated(spark, rows, max(tops) * 2, 0.01)
    assert roas([peak[x.channel] for x in b]) == pytest.approx(max(tops), rel=1e-6)


def test_channels_without_revenue_get_their_lower_bound(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.8, 0.0, 0.1), ("b", 30.0, 0.8, 1.0, 0.1)], CURVE)
    bounds, got = allocated(spark, rows, 0.0, 0.01)
    assert got["a"] == bounds["a"].lower and got["b"] == bounds["b"].upper
