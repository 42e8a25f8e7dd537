"""Runs of words that repeat with a period, by internal pattern matching.

Words are numbered, and a text is cut into dyadic blocks: 8 words, 16, and so on, each
length from the text's start on. A block asks for its occurrences in the window after it:
the block's range of the suffix array, and there the least place from a word on, which a
wavelet tree over the suffix array answers. Occurrences in such a window are one arithmetic
progression. Of one or two, the distance to the block is a candidate period; of three or
more, the candidates shift one end of the stretch that has the progression's step as period,
round the block, to the same end round the progression. A run of period q and 3 * q words or
more holds a block of at most q words (of 8, if q is less) and its copy q words on, so each
run is found; longest common extensions, by the ranks of the suffix array's doubling, check a
candidate and give its run.

Only places whose 8 words stand twice in their text can answer a query, so the arrays hold
these alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit.llm.common import SPACE, bytes_of, mixed, slices, table, word_runs
from roaskit.llm.wavelet import WaveletTree

#: Words of the shortest block, as a power of two; a run has LEAST words and REPEATS periods or more.
FIRST, LEAST, REPEATS = 3, 24, 3
SHORT = 1 << FIRST
WORD = r"[^\x20\x09-\x0D]+"


def numbered_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of each word (equal words have equal numbers), the words, and each row's first (one more than rows)."""
    raw, offsets = bytes_of(column)
    inside = ~SPACE[raw]
    starts, ends, first = word_runs(inside, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[inside])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64), words, first


def dense(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of the keys, equal for equal keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeated_places(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places whose SHORT words may stand twice in their row, all that do among them: counts of hashes, twice."""
    n = len(words) - SHORT + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value = mixed(words.astype(np.uint64))
    hashes = np.zeros(n, np.uint64)
    for j in range(SHORT):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + value[j:n + j]
    hashes = mixed(hashes + mixed(row[:n].astype(np.uint64)))
    places = np.flatnonzero(row[:n] == row[SHORT - 1:])
    bits = np.uint64(max(16, int(4 * n).bit_length()))
    for shift in (np.uint64(64) - bits, np.uint64(0)):
        slot = ((hashes[places] >> shift) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        places = places[np.bincount(slot, minlength=1)[slot] > 1]
    return places


class Doubling:
    """The suffix array of the places whose SHORT words repeat within their row, and their ranks at each power of two.

    `levels` holds for 2**k words the places of a class of two or more in ascending order, the
    class's start in the suffix array, and its size. Ranks never join places of two rows.
    """

    def __init__(self, words: np.ndarray, row: np.ndarray, first: np.ndarray):
        self.words, self.row, self.first = words, row, first
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        places = repeated_places(words, row)
        ranks = self._exact(places)
        places, ranks, size = self._classes(places, ranks)
        self.places = places
        self.rank = ranks.copy()                          # start of the class in the suffix array
        k = FIRST
        longest = int(np.diff(first)[row[places]].max()) if len(places) else 0
        while len(places):
            self.levels[k] = (places, ranks, size)
            if REPEATS << (k + 1) > longest:
                break
            places, ranks, size = self._longer(k)
            k += 1
        order = np.argsort(self.rank, kind="stable")
        self.suffixes = self.places[order]
        self.top = max(self.levels, default=FIRST)

    def _exact(self, places: np.ndarray) -> np.ndarray:
        """Numbers that are equal just for places of one row with equal SHORT words."""
        keys = self.words[places[:, None] + np.arange(SHORT)].reshape(-1)
        while len(keys) > len(places):                    # neighbours become one number
            keys = dense(keys[0::2] * (int(keys.max()) + 1) + keys[1::2])
        return dense(self.row[places] * (int(keys.max()) + 1 if len(keys) else 1) + keys)

    @staticmethod
    def _classes(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of classes of two or more, the start of each one's class among them, and its size."""
        count = np.bincount(keys, minlength=1) if len(keys) else np.zeros(1, np.int64)
        several = count[keys] > 1
        places, keys = places[several], keys[several]
        kept = np.where(count > 1, count, 0)
        start = np.cumsum(kept) - kept
        return places, start[keys], count[keys]

    def _longer(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of twice as many words: by the own rank, then by the rank that many words on (none has one of its own kind)."""
        places, ranks, _ = self.levels[k]
        second = self.ranks_at(k, places + (1 << k))
        alone = second < 0
        second[alone] = len(self.places) + np.arange(int(alone.sum()))
        order = np.lexsort((second, ranks))
        r, s = ranks[order], second[order]
        new_class = np.ones(len(r), bool)
        new_class[1:] = r[1:] != r[:-1]
        new = new_class.copy()
        new[1:] |= s[1:] != s[:-1]
        at = np.arange(len(r))
        head = np.maximum.accumulate(np.where(new_class, at, 0))
        mine = np.maximum.accumulate(np.where(new, at, 0))
        start = r + (mine - head)                         # the class starts as far into the old one
        size = np.diff(np.r_[np.flatnonzero(new), len(r)])[np.cumsum(new) - 1]
        back = np.empty_like(order)
        back[order] = at
        start, size = start[back], size[back]
        self.rank[np.searchsorted(self.places, places)] = start
        several = size > 1
        return places[several], start[several], size[several]

    def ranks_at(self, k: int, at: np.ndarray) -> np.ndarray:
        """The rank of 2**k words from each place on, or -1 where none in the row equals them."""
        places, ranks, _ = self.levels[k]
        i = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[i] == at, ranks[i], -1)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a on and from b on, within their row (a < b)."""
        end, a, b = self.first[self.row[a] + 1], a.copy(), b.copy()
        start = a.copy()
        for k in range(self.top, FIRST - 1, -1):
            while True:
                ra = self.ranks_at(k, a)
                on = (ra >= 0) & (ra == self.ranks_at(k, b))
                a[on] += 1 << k
                b[on] += 1 << k
                if k < self.top or not on.any():
                    break
        last = len(self.words) - 1
        going = np.ones(len(a), bool)
        for _ in range(SHORT):
            going &= (b < end) & (self.words[np.minimum(a, last)] == self.words[np.minimum(b, last)])
            a[going] += 1
            b[going] += 1
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree up to a and up to b (both left out), within their row (a < b)."""
        low, a, b = self.first[self.row[a]], a.copy(), b.copy()
        start = a.copy()
        for k in range(self.top, FIRST - 1, -1):
            while True:
                ra = self.ranks_at(k, a - (1 << k))
                on = (a - (1 << k) >= low) & (ra >= 0) & (ra == self.ranks_at(k, b - (1 << k)))
                a[on] -= 1 << k
                b[on] -= 1 << k
                if k < self.top or not on.any():
                    break
        going = np.ones(len(a), bool)
        for _ in range(SHORT):
            going &= (a > low) & (self.words[np.maximum(a - 1, 0)] == self.words[np.maximum(b - 1, 0)])
            a[going] -= 1
            b[going] -= 1
        return start - a


def candidates(d: Doubling) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (their first place) and a period that each may have."""
    tree = WaveletTree(np.searchsorted(d.places, d.suffixes), len(d.places))
    beyond = 1 << 60
    padded = np.r_[d.places, beyond]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k, (places, ranks, size) in d.levels.items():
        m = 1 << k
        aligned = (places - d.first[d.row[places]]) % m == 0
        block, left, right = places[aligned], ranks[aligned], (ranks + size)[aligned]

        def next_place(start: np.ndarray, which: np.ndarray) -> np.ndarray:
            """The block's first occurrence at `start` or after it."""
            got = tree.successor(left[which], right[which], np.searchsorted(d.places, start))
            return padded[np.where(got < 0, len(d.places), got)]

        every = np.arange(len(block))
        if k == FIRST:
            near = next_place(block + 1, every)
            some = near < block + m
            found.append((block[some], (near - block)[some]))
        one = next_place(block + m, every)
        some = one < block + 2 * m
        every, one = every[some], one[some]
        found.append((block[every], one - block[every]))
        two = next_place(one + 1, every)
        some = two < block[every] + 2 * m
        every, one, two = every[some], one[some], two[some]
        found.append((block[every], two - block[every]))
        some = next_place(two + 1, every) < block[every] + 2 * m
        every, one, step = every[some], one[some], (two - one)[some]
        b = block[every]                                  # three or more: a progression
        for shift in (one - d.backward(one, one + step) - (b - d.backward(b, b + step)),
                      one + d.forward(one, one + step) - (b + d.forward(b, b + step))):
            fits = (shift >= m) & (shift < 2 * m)
            found.append((b[fits], shift[fits]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def runs_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start (word of the row), length and smallest period of every run, by row, start and period."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    d = Doubling(words, row, first)
    if not d.levels:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    block, period = np.unique(np.stack(candidates(d)), axis=1)
    inside = block + period < d.first[d.row[block] + 1]
    block, period = block[inside], period[inside]
    start = block - d.backward(block, block + period)
    end = block + period + d.forward(block, block + period)
    long = end - start >= np.maximum(LEAST, REPEATS * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), bool)                  # one stretch, several periods: multiples of the smallest
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    of = row[start]
    return of, start - first[of], end - start, period


def words_kept(first: np.ndarray, of: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    change = np.zeros(first[-1] + 1, np.int64)
    np.add.at(change, first[of] + start + period, 1)
    np.add.at(change, first[of] + start + length, -1)
    return np.cumsum(change)[:-1] == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (array of start, length and period in words, by start, then period) and collapsed of every row.

    A run is a stretch of consecutive words with smallest period q, of 24 words and 3 * q or
    more, that no neighbouring word extends. `collapsed` is the text without the words that a
    run repeats, one space between words. A null or empty text has no runs and collapses to an
    empty one. Every row is worked off by itself, so ids may be null or repeated; other columns
    are not read; an empty table gives no rows. A task holds about a megabyte of texts at a
    time, or one longer text.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                numbers, words, first = numbered_words(part.column("_text"))
                of, *found = runs_of(numbers, first)
                kept = words_kept(first, of, *found)
                left = np.r_[0, np.cumsum(kept)][first]
                texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.filter(pa.array(kept))), pa.scalar(b" ", pa.large_binary()))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(first))), pa.int32()),
                                                pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], fields=list(run)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(first), pa.int64()), runs, texts.cast(pa.string())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(task, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row; where crc32 of the id is a multiple of 10, words from one on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    chosen = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    n = F.size("words")
    g = F.floor(F.col("h") / 10)
    chosen = chosen.select("doc_id", "text", "words", g.alias("g"), F.when(n > 0, n).alias("n")).withColumn("a", F.expr("int(g % n)"))
    chosen = chosen.withColumn("p", F.expr("1 + int((n - a) div (3 + g % 8))"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a)")
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text"))
    return chosen.select("doc_id", text.alias("text"))


def digested(runs: DataFrame) -> DataFrame:
    """The columns of the query out of those of `periodic_runs`."""
    better = ("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (best, r) -> "
              "CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)")
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    best = runs.withColumn("best", F.expr(better))
    return best.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                       F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(F.encode(F.expr(lines), "UTF-8"), 256).alias("runs_sha256"),
                       F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(periodic_runs(with_planted_periods(table(spark, sf_dir, "documents"))))
