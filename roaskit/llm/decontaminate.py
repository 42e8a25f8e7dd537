"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (a run of `MIN_WORDS` words, found by
running Karp-Rabin hashes of both) are tiled: the longest match of words that are free in
both is marked, again and again, until none of `MIN_WORDS` words is left. Tiles may stand
in any order, so passages that were reordered are caught. An item counts as leaked if its
tiles cover `COVERAGE` of its words.

The benchmark is the stated query set. It is broadcast in blocks of a checked number of
words, and each block is a pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit.llm.common import bytes_of, byte_values, id_and_text, is_in, mixed, plain_text, run_hashes, slices, table, without, word_runs
from roaskit.sources.storage import materialize

MIN_WORDS, COVERAGE = 4, 0.6
#: Bound of a broadcast: words of the benchmark in one block.
BLOCK_WORDS = 1_000_000

_VALUES = byte_values(4)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts (runs of letters, digits and bytes beyond ASCII), and each row's first (one more than rows)."""
    raw, offsets = bytes_of(column)
    starts, ends, first = word_runs(_WORD[raw], offsets)
    return run_hashes(_VALUES[raw], starts, ends), first


def seeds_of(words: np.ndarray, n: int) -> np.ndarray:
    """The Karp-Rabin hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j:len(words) - n + 1 + j]
    return mixed(out)


class Runs:
    """Names for the runs of an item's words and of a text's, equal for equal runs: those of 2**k words come from two of half the length."""

    def __init__(self, words: np.ndarray):
        self.names = [np.unique(words, return_inverse=True)[1]]

    def named(self, size: int) -> np.ndarray:
        """The name of the run of `size` words at each place."""
        k = size.bit_length() - 1
        while len(self.names) <= k:
            half, last = 1 << len(self.names) - 1, self.names[-1]
            self.names.append(np.unique(last[:-half] * len(last) + last[half:], return_inverse=True)[1])
        whole, left = self.names[k], size - (1 << k)
        return whole[:len(whole) - left] * len(self.names[0]) + whole[left:]


def tiles(item: np.ndarray, text: np.ndarray, at: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiling of an item over a text: (place in the item, place in the text, words) of every tile.

    at: the places of the text where a run of `least` words of the item may begin. The longest
    match is marked first; of equal ones that which begins first in the item, then in the text.
    Runs of one length are compared by name, all at once, so words that repeat cost no pair of
    places each; as tiles don't overlap, there are few lengths.
    """
    n = len(item)
    held = np.unique(np.asarray(at, np.int64)[:, None] + np.arange(least))
    cut = np.flatnonzero(np.diff(held) > 1) + 1       # a break parts words that are no neighbours
    place = np.r_[np.arange(n), -1, np.insert(held, cut, -1)]
    runs = Runs(np.r_[item, item[:1], np.insert(text[held], cut, 0)])
    taken = place < 0

    def free(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The names of the runs of a length, and the places in the item and in the text where all their words are free."""
        marks = np.r_[0, np.cumsum(taken)]
        whole = np.flatnonzero(marks[size:] == marks[:-size])
        return runs.named(size), whole[whole < n], whole[whole > n]

    def shared(size: int) -> bool:
        names, mine, theirs = free(size)
        return bool(len(mine) and len(theirs) and np.isin(names[mine], names[theirs]).any())

    out, most = [], min(n, len(held))
    while most >= least and shared(least):
        low, step = least, 1
        while low + step <= most and shared(low + step):   # doubled steps, then halved ones
            low, step = low + step, 2 * step
        while step:
            if low + step <= most and shared(low + step):
                low += step
            step //= 2
        most = low
        names, mine, theirs = free(most)
        mine = mine[np.isin(names[mine], names[theirs])]
        theirs = theirs[np.argsort(names[theirs], kind="stable")]
        known, first = np.unique(names[theirs], return_index=True)
        next_of, end_of = first.tolist(), np.r_[first[1:], len(theirs)].tolist()
        for p, k in zip(mine.tolist(), np.searchsorted(known, names[mine]).tolist()):
            if taken[p] or taken[p + most - 1]:       # tiles of this length only lie in the way
                continue
            while next_of[k] < end_of[k]:
                t = int(theirs[next_of[k]])
                next_of[k] += 1
                if not taken[t] and not taken[t + most - 1]:
                    taken[p:p + most] = taken[t:t + most] = True
                    out.append((p, int(place[t]), most))
                    break
        most -= 1
    return sorted(out)


class Benchmark:
    """A block of items: their words, and which items have a seed."""

    def __init__(self, ids: list, words: np.ndarray, first: np.ndarray, least: int):
        self.ids, self.least = ids, least
        self.items = [words[a:b] for a, b in zip(first[:-1], first[1:])]
        each = [seeds_of(w, least) for w in self.items]
        ends = np.cumsum([len(s) for s in each])
        self.seeds, named = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_inverse=True)
        self.own = np.split(named.astype(np.int32), ends[:-1])      # the seeds of each item, in its order
        owner = np.repeat(np.arange(len(each)), [len(s) for s in each])
        pairs = np.unique(named * max(1, len(each)) + owner)
        seed, self.item = np.divmod(pairs, max(1, len(each)))
        self.start = np.searchsorted(seed, np.arange(len(self.seeds) + 1))

    def leaks(self, words: np.ndarray, first: np.ndarray, coverage: float) -> Iterator[tuple[int, int, list]]:
        """Row, item and tiles of each item that a row covers enough of."""
        seeds = seeds_of(words, self.least)
        hit = np.flatnonzero(is_in(seeds, self.seeds))
        row = np.searchsorted(first, hit, "right") - 1
        inside = hit + self.least <= first[row + 1]
        hit, row = hit[inside], row[inside]
        known = np.searchsorted(self.seeds, seeds[hit])
        for r in np.unique(row).tolist():
            a, b = np.searchsorted(row, [r, r + 1])
            places, mine = hit[a:b] - first[r], known[a:b]
            found = np.unique(mine)
            text = words[first[r]:first[r + 1]]
            for i in np.unique(np.concatenate([self.item[self.start[k]:self.start[k + 1]] for k in found])).tolist():
                item = self.items[i]
                least = coverage * len(item)
                if self.least * len(places) < least:
                    continue
                begins = np.flatnonzero(is_in(self.own[i], found))
                most = np.zeros(len(item) + 1, np.int64)            # no tile reaches beyond the seeds
                most[begins] += 1
                np.subtract.at(most, begins + self.least, 1)
                if (np.cumsum(most) > 0).sum() < least:
                    continue
                got = tiles(item, text, places[np.isin(mine, self.own[i])], self.least)
                if sum(n for _, _, n in got) >= least:
                    yield r, i, got


def benchmark_blocks(items: DataFrame, least: int, most_words: int) -> Iterator[Benchmark]:
    """The texts (_digest, _text; no two are equal) in blocks of at most `most_words` words each; only a longer text stands in a block alone."""
    sizes = items.select(F.length(F.regexp_replace("_text", r"[^\s]+", "x")).alias("w"))  # no fewer than half the words
    total = sizes.agg(F.sum("w")).first()[0] or 0
    n = max(1, -(-2 * total // most_words))
    while True:
        block = F.pmod(F.xxhash64("_digest"), F.lit(n))
        largest = items.groupBy(block).agg(F.sum(F.octet_length("_text")).alias("b"), F.count(F.lit(1)).alias("rows"))
        top = largest.filter("rows > 1").agg(F.max("b")).first()[0] or 0
        if top <= 8 * most_words:
            break
        n *= 2
    for k in range(n):
        got = items.filter(block == k).toArrow().combine_chunks()
        if got.num_rows:
            words, first = words_of(got.column("_text").combine_chunks() if isinstance(got.column("_text"), pa.ChunkedArray) else got.column("_text"))
            yield Benchmark(got.column("_digest").to_pylist(), words, first, least)


def keyed_leaks(texts: DataFrame, items: DataFrame, least: int, coverage: float, block_words: int) -> DataFrame:
    """_id, _key, _digest, item_words, matched_words, coverage and tiles of each leaked text of `items` (_digest, _text) in each row of _id, _key, _text.

    One block after the other is broadcast, its leaks are written, and it is released.
    """
    tile = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())])
    schema = pa.schema([("_id", pa.int64()), ("_key", pa.int64()), ("_digest", pa.string()), ("item_words", pa.int64()), ("matched_words", pa.int64()),
                        ("coverage", pa.float64()), ("tiles", pa.list_(tile))])
    ddl = ("_id long, _key long, _digest string, item_words long, matched_words long, coverage double, "
           "tiles array<struct<item_start:int,doc_start:int,words:int>>")
    spark = texts.sparkSession

    def passed(bench) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: Benchmark = bench.value
            for batch in batches:
                for part in slices(batch):
                    words, first = words_of(part.column("_text"))
                    ids, keys, rows = part.column("_id").to_pylist(), part.column("_key").to_pylist(), []
                    for r, i, got in block.leaks(words, first, coverage):
                        n, of = sum(t[2] for t in got), len(block.items[i])
                        rows.append({"_id": ids[r], "_key": keys[r], "_digest": block.ids[i], "item_words": of, "matched_words": n, "coverage": n / of,
                                     "tiles": [dict(zip(("item_start", "doc_start", "words"), t)) for t in got]})
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)
        return texts.select("_id", "_key", "_text").mapInArrow(task, ddl)

    parts = []
    for block in benchmark_blocks(items, least, block_words):
        shared = spark.sparkContext.broadcast(block)
        parts.append(materialize(passed(shared), "leaks"))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ddl)


def _queries(items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """item_id, _digest and _text (lower case) of every item."""
    rows = id_and_text(items, item_col, item_text_col).withColumn("_text", F.lower("_text"))
    return rows.select(F.col("_id").alias("item_id"), F.sha2("_text", 256).alias("_digest"), "_text")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", least: int = MIN_WORDS, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, item_words, matched_words, coverage and tiles (places in words) of each leaked item of each row.

    Words are compared without case and punctuation. A null text has no words; an item of
    fewer than `least` words has no seed and is never reported; repeated rows and items are
    reported each, though equal items are searched once; ids may be null; an empty table on
    either side gives no rows. Other columns may have any name.
    """
    queries = _queries(items, item_col, item_text_col)
    texts = id_and_text(docs, id_col, text_col).withColumns({"_text": F.lower("_text"), "_key": F.lit(0).cast("long")})
    found = keyed_leaks(texts, queries.dropDuplicates(["_digest"]), least, coverage, block_words)
    return found.join(queries.select("item_id", "_digest"), "_digest").select(
        F.col("_id").alias("doc_id"), "item_id", "item_words", "matched_words", "coverage", "tiles")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, that leak no item; rows without an id stay.

    A row goes for its own text: others of its id stay. Null texts and empty tables as in
    `leaks`; other columns may have any name.
    """
    keyed = id_and_text(docs, id_col, text_col).select("_id", F.xxhash64("_text").alias("_key"), F.lower("_text").alias("_text"))
    found = keyed_leaks(keyed, _queries(items, "item_id", "text").dropDuplicates(["_digest"]), MIN_WORDS, COVERAGE, BLOCK_WORDS)
    return without(docs, found, id_col, F.xxhash64(plain_text(text_col)))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
