import random
import re
from collections import defaultdict

import pytest

from roaskit.llm import mixing as m

DDL = "doc_id long, text string, source string, p double, place string"


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """What is above is cut and shared again, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, full, left = {}, set(), share * sum(sizes.values())
    while True:
        level = (left - sum(most * sizes[s] for s in full)) / (sum(weight[s] for s in names if s not in full) or 1)
        over = {s for s in names if s not in full and weight[s] * level > most * sizes[s]}
        if not over:
            got.update({s: weight[s] * level for s in names if s not in full} | {s: most * sizes[s] for s in full})
            return got
        full |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def made(rng, n, sources):
    return [(i, " ".join(["w"] * int(rng.paretovariate(0.9) * 5)), rng.choice(sources), 0.5, "x") for i in range(n)]


def verify(rows, got, near):
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += words(text)
    want = targets(sizes) if sizes else {}
    assert sorted(map(repr, ((r.id, r.source, r.size) for r in got))) == sorted(map(repr, ((i, s, words(t)) for i, t, s, *_ in rows)))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for source, total in taken.items():
        assert abs(total - want[source]) <= near(source, sizes[source]), (source, total, want[source])


def test_targets_and_totals_by_source(spark):
    rng = random.Random(8)
    rows = made(rng, 6000, ["big"] * 6 + ["a", "é", "\U0001F600", "￿", None, "", "null"])
    df = spark.createDataFrame(rows, DDL)
    whole = m.mixed_sources(df).collect()
    verify(rows, whole, lambda s, size: max(30, 0.002 * size))
    # buckets of every number, rows in any order, batches of any size: same totals, and a rerun is the same
    for rows_each, fan_in in ((100, 4), (700, 64)):
        verify(rows, m.mixed_sources(df, bucket_rows=rows_each, fan_in=fan_in).collect(), lambda s, size: max(30, 0.002 * size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        again = m.mixed_sources(df.repartition(7, "text")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, again)) == sorted(map(repr, whole))


def test_documents_and_words_keep_to_their_expectation_in_the_flight():
    rng = random.Random(1)
    sizes = sorted((rng.randrange(1, 400) for _ in range(3000)), reverse=True)
    p = [0.37] * 3000
    after = m.Flight().over([0] * 3000, sizes, p, [rng.random() for _ in p])
    assert sum(0 < x < 1 for x in after) <= 2 and set(x for x in after if not 0 < x < 1) == {0.0, 1.0}
    assert sum(after) == pytest.approx(sum(p)) and sum(x * s for x, s in zip(after, sizes)) == pytest.approx(sum(x * s for x, s in zip(p, sizes)))


def test_inclusion_keeps_its_probability():
    rng = random.Random(6)
    sizes, taken = [50, 40, 40, 30, 20, 20, 10, 5], [0.0] * 8
    for _ in range(4000):
        for i, x in enumerate(m.Flight().over([0] * 8, sizes, [0.3] * 8, [rng.random() for _ in sizes])):
            taken[i] += x / 4000
    assert all(abs(x - 0.3) < 0.03 for x in taken)


def test_landing_takes_the_nearer_side():
    assert m.landed([100, 10, 4], [0.6, 0.5, 0.5]) == [1.0, 0.0, 0.0]
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randrange(1 << k, 2 << k) for k in range(10) for _ in range(2)]
        p = [rng.random() for _ in sizes]
        out = m.landed(sizes, p)
        assert set(out) <= {0.0, 1.0} and abs(sum((x - y) * s for x, y, s in zip(out, p, sizes))) <= max(sizes) / 2


def test_odd_rows(spark, odd_documents):
    odd = [(1, "a b", "s", 1.0, "x"), (1, "a b", "s", 1.0, "x"), (None, "c", None, None, None), (2, None, "empty", 0.0, "y"), (3, "", "empty", 0.0, "y"),
           (4, "word " * 60_000, "long", 0.0, "z"), (None, None, None, None, None), (5, "\x0b\x1cx\xa0y", "t", 0.0, "z")]
    for rows in (odd, [], odd[3:5]):
        got = m.mixed_sources(spark.createDataFrame(rows, DDL)).collect()
        verify(rows, got, lambda s, size: max(30, size))
    with pytest.raises(ValueError):
        m.mixed_sources(odd_documents.withColumn("source", m.F.lit("s")), share=3)
