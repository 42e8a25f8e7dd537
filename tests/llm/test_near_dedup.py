import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from roaskit.llm import near_dedup as m
from roaskit.llm.components import components


def shingles(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    sets = {}
    for r in rows:
        sets.setdefault(r.doc_id, []).append(shingles(r.text))
    nodes = sorted(k for k in sets if k is not None)
    label = {k: k for k in nodes}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if any(x & y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = top(a), top(b)
            label[max(x, y)] = min(x, y)
    return sorted(((r.doc_id, len(shingles(r.text)), None if r.doc_id is None else top(r.doc_id), r.doc_id is None or top(r.doc_id) == r.doc_id) for r in rows), key=repr)


def rows_of(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_groups(docs).collect()), key=repr)


def test_groups_equal_brute_force(spark, documents):
    assert rows_of(documents) == plain(documents.collect())


def group_of_copies(n, seed, words=60, most=9):
    """Copies of one text with up to `most` words replaced, one after another: many are alike only by way of others."""
    rng = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.sample(range(words), rng.randrange(most)):
            text[at] = f"v{rng.randrange(40)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("limit, block", [(32, 1 << 18), (4, 150)])
def test_large_groups_and_shared_passages(spark, monkeypatch, limit, block):
    monkeypatch.setattr(m, "LIST", limit)
    monkeypatch.setattr(m, "BLOCK_SHINGLES", block)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [*group_of_copies(70, 1), *group_of_copies(50, 2, words=12, most=3), *(f"{passage} {' '.join(f'o{k}y{i}' for i in range(25))}" for k in range(45)),
             *(f"{passage} z{k // 3} {'tail ' * (k % 3)}" for k in range(45))]
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string")
    assert rows_of(docs) == plain(docs.collect())


def test_odd_rows(spark):
    long = "word " * 60_000
    rows = [(None, "a b c d e f g h", 1), (2, "A b  C d\te f g h", 2), (1, "a b c d e f g h", None), (3, None, 3), (4, "", 4), (5, " \n", 5), (6, "one two", 6), (7, "One\ntwo", 7),
            (8, "two one", 8), (9, long, 9), (10, long + "x", 9), (2, "A b  C d\te f g h", 2), (11, "É b c d e f", 1), (12, "é b c d e f", 1), (13, "q", 1), (14, "Q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    assert rows_of(docs) == plain(docs.collect())
    assert m.near_groups(docs.limit(0)).count() == 0
    assert sorted((r.doc_id for r in m.without_near_copies(docs).collect()), key=repr) == sorted([None, 1, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13], key=repr)


def test_sets_equal_brute_force():
    texts = ["", "a", "a b", "a b c d", "d c b a", "a b c d e", "a b c d e f a b c d e", "x " * 30, None]
    hashes, first = m.shingle_sets(pa.array(texts))
    assert np.diff(first).tolist() == [len(shingles(t)) for t in texts]
    alone = [m.shingle_sets(pa.array([t]))[0] for t in texts]
    assert all((hashes[a:b] == x).all() for a, b, x in zip(first[:-1], first[1:], alone))
    assert len(set(map(bytes, alone))) == len({frozenset(shingles(t)) for t in texts})


def test_estimate_of_whole_sets_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 30, rng.integers(1, 24))).astype(np.uint64) for _ in range(2))
        union = len(np.union1d(x, y))
        assert m.estimate(x, y) == (len(np.intersect1d(x, y)) / union if union else 0)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 400), (600, 400)]
    pairs = [(a, b) for a, b in pairs if a != b]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
