import random
import re
import time

import numpy as np

from roaskit.llm import decontaminate as m
from roaskit.llm.common import table
from tests.llm.conftest import SMALL


def plain_tiles(item, text, least):
    """Greedy tiling by trying every pair of places."""
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = None
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and free_i[p + n] and free_t[t + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, p, t)
        if best is None:
            return sorted(out)
        n, p, t = best
        for k in range(n):
            free_i[p + k] = free_t[t + k] = False
        out.append((p, t, n))


def test_tiling_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        item, text = ([rng.randrange(4) for _ in range(rng.randrange(3, 16))] for _ in range(2))
        hits = sorted({t for p in range(len(item) - 2) for t in range(len(text) - 2) if item[p:p + 3] == text[t:t + 3]})
        assert m.tiles(np.array(item), np.array(text), np.array(hits, int), 3) == plain_tiles(item, text, 3)


def test_words_that_repeat_take_little_time():
    start = time.time()
    one = np.zeros(100_000, np.uint64)
    assert m.tiles(one[:20_000], one, np.arange(100_000 - 3)) == [(0, 0, 20_000)]
    two = np.arange(60_000, dtype=np.uint64) % 2
    got = m.tiles(np.r_[two[:9_000], 7, two[:9_000]], two, np.arange(60_000 - 3))
    assert sorted(n for _, _, n in got) == [9_000, 9_000] and len({t for _, t, _ in got}) == 2
    assert time.time() - start < 20


def test_repeated_words_equal_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        item, text = ([int(rng.random() < 0.1) for _ in range(rng.randrange(4, 24))] for _ in range(2))
        words, first = np.array(item + text, np.uint64), np.array([0, len(item), len(item) + len(text)])
        block = m.Benchmark(["x"], words[:len(item)], np.array([0, len(item)]), 4)
        got = {r: t for r, _, t in block.leaks(words, first, 0.6)}
        for r, x in enumerate((item, text)):
            plain = plain_tiles(item, x, 4)
            assert got.get(r, plain) == plain and (r in got) == (sum(t[2] for t in plain) >= 0.6 * len(item))


def test_rows_equal_brute_force(spark, documents):
    items = table(spark, SMALL, "benchmark")
    words = lambda s: re.findall(r"[0-9a-z\x80-\U0010ffff]+", s.lower())
    wanted = set()
    for b in items.collect():
        item = words(b.text)
        seeds = {tuple(item[i:i + m.MIN_WORDS]) for i in range(len(item) - m.MIN_WORDS + 1)}
        for d in documents.collect():
            text = words(d.text)
            if any(tuple(text[i:i + m.MIN_WORDS]) in seeds for i in range(len(text))) and len(text) < 600:
                n = sum(x[2] for x in plain_tiles(item, text, m.MIN_WORDS))
                if n >= m.COVERAGE * len(item):
                    wanted.add((d.doc_id, b.item_id, n))
    for block in (m.BLOCK_WORDS, 300):
        rows = m.leaks(documents, items, block_words=block).collect()
        got = {(r.doc_id, r.item_id, r.matched_words) for r in rows}
        short = {d.doc_id for d in documents.collect() if len(words(d.text)) < 600}
        assert {x for x in got if x[0] in short} == wanted and len(rows) == len(got)


def test_reordered_passage_and_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "x SEVEN, eight; nine ten eleven twelve! y z one two three four five six", 1), (2, "one two three x four five six x seven eight nine x ten eleven twelve", 2),
            (None, item, 3), (3, None, None), (4, "", 4), (5, "a " * 100_000 + item, 5), (5, "a " * 100_000 + item, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, "too few words"), (9, None), (None, item)], "item_id long, text string")
    got = m.leaks(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == sorted([(d, i) for d in (1, None, 5, 5) for i in (7, None)], key=repr)
    assert [tuple(t) for t in next(r for r in got if r.doc_id == 1).tiles] == [(0, 9, 6), (6, 1, 6)]
    assert sorted(((r.doc_id for r in m.decontaminated(docs, items).collect())), key=repr) == sorted([2, None, 3, 4], key=repr)
    assert m.leaks(docs.limit(0), items).count() == 0 and m.leaks(docs, items.limit(0)).count() == 0
