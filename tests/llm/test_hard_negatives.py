import math
import random

import numpy as np

from roaskit.llm import hard_negatives as m

DDL = "vec_id long, embedding array<double>, label int, score string"


def brute(rows, positives=5, negatives=10):
    def whole(v):
        return [math.floor(256 * x) for x in v]

    good = {(i, lab, tuple(whole(v))) for i, v, lab, *_ in rows
            if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, lab, v in good:
        if i % 100:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(v, w)), j, other == lab) for j, other, w in good if j != i})
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            fit = [(-t, k) for t, k, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s]
            out |= {(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(fit[:negatives])}
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r) for r in m.hard_negatives(df, m.F.col("id") % 100 == 0, **how).collect())


def made(rng, n, width, spread=1.0, labels=3):
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(5)]
    return [(i * 10, [round(c + rng.gauss(0, 0.3), 1) for c in rng.choice(centres)], rng.randrange(labels), "x") for i in range(n)]


def test_equal_to_brute_force_in_blocks_of_every_size(spark):
    rng = random.Random(2)
    for width, spread in ((2, 1.0), (6, 0.5), (12, 0.0)):
        rows = made(rng, 230, width, spread)
        df = spark.createDataFrame(rows, DDL).repartition(3)
        want = brute(rows)
        assert want
        assert found(df) == want
        if width == 6:
            assert found(df, anchor_bytes=2000, list_rows=32) == want


def test_nulls_ties_repeats_lengths_signs_and_huge_components(spark):
    rng = random.Random(4)
    rows = made(rng, 60, 3)
    rows += rows[:25] + [(None, [1.0] * 3, 1, None), (700, None, 1, None), (701, [1.0, None, 2.0], 1, None), (702, [math.nan, 0.0, 0.0], 0, None),
                         (703, [math.inf, 0.0, 0.0], 0, None), (704, [0.1, 0.2, 0.3], None, None), (800, [0.0, 0.0, 0.0], 0, None), (900, [], 1, None),
                         (905, [3.0], 2, None), (1000, [-1.0, -2.0, 0.5], 1, "y"), (-100, [1.0, 1.0, 1.0], 1, "y")]
    assert found(spark.createDataFrame(rows, DDL)) == brute(rows)
    huge = [(i * 50, [float(rng.randrange(1 << 29)), float(rng.randrange(1 << 20))], i % 2, None) for i in range(40)]
    got = found(spark.createDataFrame(huge, DDL), scale=1, list_rows=16)
    m_brute = [(i, [x / 256 for x in v], lab, s) for i, v, lab, s in huge]
    assert [r[:4] for r in got] == [r[:4] for r in brute(m_brute)]
    assert found(spark.createDataFrame(rows, DDL).limit(0)) == []
    assert found(spark.createDataFrame([(1, [1.0], 1, None)], DDL)) == []


def test_search_stops_before_the_end_and_the_threshold_is_a_bound():
    rng = np.random.default_rng(7)
    vectors = np.floor(256 * rng.normal(size=(4000, 2)))
    lists = m.SortedLists(np.arange(4000), np.ones(4000, np.int64), vectors)
    anchors = vectors[:8]
    for depth in (1, 30, 400):
        met = np.zeros((8, 4000), bool)
        lists.meet(met, np.arange(8), anchors, 0, depth)
        unseen = np.where(met, -np.inf, anchors @ vectors.T)
        assert (unseen.max(axis=1) <= lists.thresholds(anchors, depth)).all()
    asked = []
    lists.meet = lambda met, which, a, start, end, f=lists.meet: (asked.append(end), f(met, which, a, start, end))
    best = {}
    wide = np.full((8, 1), 1 << 62)
    m.search(lists, anchors, np.arange(8), np.ones(8, np.int64), True, -wide, wide, 5, best)
    assert max(asked) < 2000
    for a in range(8):
        want = sorted((-int(s), i) for i, s in enumerate(vectors @ anchors[a]) if i != a)[:5]
        assert best[a, 0] == want
