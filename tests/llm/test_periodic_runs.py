import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from roaskit.llm import periodic_runs as m
from roaskit.llm.wavelet import WaveletTree


def brute(words):
    """Every run: for each period the maximal stretches, the smallest period of a stretch."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(texts):
    words = [t.split() for t in texts]
    code = {w: i for i, w in enumerate(dict.fromkeys(w for t in words for w in t))}
    first = np.r_[0, np.cumsum([len(t) for t in words])].astype(np.int64)
    of, *runs = m.runs_of(np.array([code[w] for t in words for w in t], np.int64), first)
    out = [[] for _ in texts]
    for r, *x in zip(of.tolist(), *(y.tolist() for y in runs)):
        out[r].append(tuple(x))
    return out


def periodic_text(rng):
    """Repeats of repeats over few words, so that runs meet, nest and overlap."""
    words = []
    while len(words) < rng.randrange(1, 400):
        unit = [rng.choice("abcd"[:rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.5:
            unit = unit * rng.randrange(1, 6) + unit[:rng.randrange(len(unit))]
        words += unit * rng.randrange(1, 7)
    if rng.random() < 0.5:
        words[rng.randrange(len(words))] = "e"
    return " ".join(words)


def test_runs_equal_brute_force_on_periodic_texts():
    rng = random.Random(5)
    for _ in range(60):
        texts = [periodic_text(rng) for _ in range(rng.randrange(1, 12))] + ["", "a", "a " * 23, "a " * 24]
        assert found(texts) == [brute(t.split()) for t in texts]


def test_fibonacci_words_and_copies_in_other_rows():
    a, b = ["a"], ["a", "b"]
    while len(b) < 1500:
        a, b = b, b + a
    cubes = " ".join(b)
    assert found([cubes, cubes, "x " + cubes]) == [brute(cubes.split())] * 2 + [brute(["x", *cubes.split()])]


def test_wavelet_tree_equals_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 37, 300):
        values = rng.permutation(n)
        left = rng.integers(0, n + 1, 200)
        right = np.minimum(n, left + rng.integers(0, n + 1, 200))
        x = rng.integers(0, n + 3, 200)
        want = [min((v for v in values[a:b] if v >= c), default=-1) for a, b, c in zip(left, right, x)]
        assert WaveletTree(values, n).successor(left, right, x).tolist() == want


@pytest.mark.parametrize("text", ["a " * 300_000, "a b c d e f g " * 40_000, " ".join(str(i % 9973) for i in range(200_000))])
def test_long_texts_take_seconds(text):
    begun = time.time()
    got = found([text])[0]
    assert len(got) == 1 and got[0][:2] == (0, len(text.split())) and time.time() - begun < 20


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            digest("".join("%d,%d,%d\n" % r for r in runs)), digest(collapsed(words, runs)))


def test_query_equals_brute_force(spark, documents, odd_documents):
    few = documents.filter("length(text) < 6000").select("doc_id", "text")
    rng = random.Random(9)
    made = spark.createDataFrame([(i, periodic_text(rng)) for i in range(60)], "doc_id long, text string")
    odd = odd_documents.filter("doc_id is null or doc_id <> 6").withColumn("runs", m.F.lit(1)).withColumn("words", m.F.lit("x"))
    for docs in (few, made, odd, few.limit(0)):
        got = sorted((tuple(r) for r in m.digested(m.periodic_runs(m.with_planted_periods(docs))).collect()), key=repr)
        assert got == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=repr)
