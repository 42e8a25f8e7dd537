"""Hard negatives by the threshold algorithm of Fagin.

Rows are dealt in blocks, and a block has one sorted list for each dimension. An anchor goes
down all lists together, each from the end where its own component makes the product large
(sorted access); the rows met are scored by their whole integer inner product (random
access); and it stops once the threshold, the score of a row that stood at the present depth
in every list, is strictly below the k-th score of each of its windows, or below the window:
no row that it hasn't met can come in then, nor tie.

Anchors are the stated query set. They are worked off in blocks of a checked size: a block is
broadcast, read by two passes over all rows (positives first, as they give the windows of
the negatives), written, and released. A pass shuffles the best rows of each task only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roaskit.llm.common import table
from roaskit.sources.storage import materialize

#: Positives of an anchor, negatives of a pair, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Bytes of a broadcast block of anchors, and rows that share sorted lists.
ANCHOR_BYTES, LIST_ROWS = 8 << 20, 8192
#: Depths at which a search looks whether it can stop, as parts of a list.
DEPTHS = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1)
#: Anchors that are worked off together, as arrays.
TOGETHER = 64
#: Integers that doubles add up exactly.
EXACT = 1 << 53


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """id, label and v (floor(scale * x) of each component, a whole number as a double) of the rows that take part."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.float64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            first = np.r_[0, np.cumsum(np.asarray(pa.compute.list_value_length(vectors).fill_null(0)))]
            flat = vectors.flatten().cast(pa.float64())
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = np.r_[0, np.cumsum(~np.isfinite(x))]
            good = (bad[first[1:]] == bad[first[:-1]]) & ~np.asarray(vectors.is_null()) & ~np.asarray(batch.column("id").is_null()) & ~np.asarray(batch.column("label").is_null())
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(np.where(np.isfinite(x), x, 0) * float(scale)), -1e300, 1e300)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(v))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), lists], schema=schema).filter(pa.array(good))

    read = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return read.mapInArrow(task, "id long, label long, v array<double>")


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of `width` numbers; shorter ones end in zeros."""
    n = np.asarray(pa.compute.list_value_length(vectors)).astype(np.int64)
    out = np.zeros((len(n), width))
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(int(n.sum())) - first[row]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer inner product of each row of a with each of b: in doubles where these are exact, else in Python's integers."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    got = whole(a).astype(object) @ whole(b).astype(object).T
    return np.clip(got, -(1 << 62), 1 << 62).astype(np.int64)


class SortedLists:
    """Rows with a list for each dimension, from the greatest component down."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.falling = np.argsort(-vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.falling, axis=0)

    def thresholds(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """An upper bound of the score of a row that each anchor hasn't met at this depth (rounding included)."""
        if depth >= len(self.ids):
            return np.full(len(anchors), -np.inf)
        best = np.where(anchors > 0, anchors, 0) @ self.values[depth] + np.where(anchors < 0, anchors, 0) @ self.values[-1 - depth]
        return best + 1e-9 * (np.abs(anchors) @ np.abs(self.values).max(axis=0))

    def meet(self, met: np.ndarray, which: np.ndarray, anchors: np.ndarray, start: int, end: int) -> None:
        """Marks the rows that the anchors `which` meet from depth `start` to `end`; a list of no weight is not read."""
        n = len(self.ids)
        for d in range(anchors.shape[1]):
            up, down = which[anchors[which, d] > 0], which[anchors[which, d] < 0]
            met[np.ix_(up, self.falling[start:end, d])] = True
            met[np.ix_(down, self.falling[n - end:n - start, d])] = True


Best = dict[tuple[int, int], list[tuple[int, int]]]


def search(lists: SortedLists, anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, same: bool,
           low: np.ndarray, high: np.ndarray, k: int, best: Best, offset: int = 0) -> None:
    """Brings `best` up to date: (anchor, window) -> the first k of (-score, id) among the rows seen so far.

    same: whether rows of the anchor's label are looked for, or of others. low, high: least and greatest score of
    each window (columns) of each anchor (rows); a window with low > high is empty.
    """
    n, windows = len(lists.ids), low.shape[1]
    allowed = (anchor_labels[:, None] == lists.labels[None]) == same
    allowed &= anchor_ids[:, None] != lists.ids[None]
    scores = np.zeros((len(anchors), n), np.int64)
    met, scored = np.zeros((len(anchors), n), bool), np.zeros(n, bool)
    open_ = np.flatnonzero((low <= high).any(axis=1) & allowed.any(axis=1))
    # what earlier blocks have given counts: a window needs more than its k-th score so far
    floor = np.array([[max(low[a, w], -got[-1][0]) if len(got := best.get((offset + a, w), [])) == k else low[a, w]
                       for w in range(windows)] for a in range(len(anchors))], dtype=float).reshape(len(anchors), windows)
    start = 0
    for part in DEPTHS:
        if not len(open_):
            break
        end = max(start + 1, min(n, int(np.ceil(n * part))))
        if end > n or start >= n:
            break
        lists.meet(met, open_, anchors, start, end)
        start = end
        new = np.flatnonzero(met[open_].any(axis=0) & ~scored)
        scored[new] = True
        scores[:, new] = products(anchors, lists.vectors[new])
        bound = lists.thresholds(anchors[open_], end)
        going = []
        for a, t in zip(open_.tolist(), bound.tolist()):
            if end >= n:
                met[a] = True                             # only lists of no weight are left: these rows score 0
                continue
            if met[a].all():
                continue
            for w in range(windows):
                if low[a, w] <= high[a, w] and t >= floor[a, w]:
                    inside = scores[a][met[a] & allowed[a] & (scores[a] >= low[a, w]) & (scores[a] <= high[a, w])] if t <= high[a, w] else ()
                    if len(inside) < k or t >= np.partition(inside, len(inside) - k)[len(inside) - k]:
                        going.append(a)
                        break
        open_ = np.array(going, np.int64)
    late = np.flatnonzero(met.any(axis=0) & ~scored)
    scores[:, late] = products(anchors, lists.vectors[late])
    for a in range(len(anchors)):
        can = np.flatnonzero(met[a] & allowed[a] & (scores[a] >= floor[a].min()) & (scores[a] <= high[a].max()))
        mine = scores[a][can]
        for w in range(windows):
            inside = (mine >= floor[a, w]) & (mine <= high[a, w])
            if inside.any():
                s, i = mine[inside], lists.ids[can[inside]]
                if len(s) > 4 * k:                        # copies of one id count once, so the k-th of different scores is a safe bound
                    different = np.unique(s)
                    enough = s >= different[max(0, len(different) - k)]
                    s, i = s[enough], i[enough]
                have = best.get((offset + a, w), [])
                best[offset + a, w] = sorted({*have, *zip((-s).tolist(), i.tolist())})[:k]


def _best_rows(rows: DataFrame, block, same: bool, k: int, list_rows: int) -> DataFrame:
    """anchor (its number in the block), window, id and score: the best of each task."""
    schema = pa.schema([("anchor", pa.int64()), ("win", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, low, high = block.value
        best: Best = {}
        held: list[pa.RecordBatch] = []

        def work() -> None:
            part = pa.Table.from_batches(held).combine_chunks()
            lists = SortedLists(part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v").combine_chunks(), vectors.shape[1]))
            for a in range(0, len(ids), TOGETHER):
                few = slice(a, a + TOGETHER)
                search(lists, vectors[few], ids[few], labels[few], same, low[few], high[few], k, best, a)

        for batch in batches:
            at = 0
            while at < batch.num_rows:                    # lists of `list_rows` rows, whatever the batches
                piece = batch.slice(at, list_rows - sum(b.num_rows for b in held))
                at += piece.num_rows
                held.append(piece)
                if sum(b.num_rows for b in held) == list_rows:
                    work()
                    held = []
        if held:
            work()
        out = [(a, w, i, -s) for (a, w), got in best.items() for s, i in got]
        for at in range(0, len(out), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[at:at + (1 << 16)])], schema=schema)

    found = rows.mapInArrow(task, "anchor long, win long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id"))
    return found.distinct().withColumn("place", place).filter(F.col("place") <= k)


def anchor_blocks(anchors: DataFrame, most: int) -> Iterator[pa.Table]:
    """The anchors in blocks of at most `most` rows, one after the other; no two anchors are equal, so a hash parts them."""
    n = max(1, -(-2 * anchors.count() // most))
    key = F.xxhash64("id", "label", "v")
    while (anchors.groupBy(F.pmod(key, F.lit(n)).alias("b")).count().agg(F.max("count")).first()[0] or 0) > most:
        n *= 2
    for b in range(n):
        got = anchors.filter(F.pmod(key, F.lit(n)) == b).toArrow()
        if got.num_rows:
            yield got.combine_chunks()


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
                   anchor_bytes: int = ANCHOR_BYTES, list_rows: int = LIST_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    is_anchor: a condition on the column `id`. An anchor's positives are its first rows of the
    same label by score, then id; of each pair, the first rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score are its negatives. Rows with a
    null id, label or vector, or a component that is null or not finite, take no part. Shorter
    vectors count as ending in zeros. Rows that share the anchor's id are never its positives or
    negatives; rows that repeat an id with the same score count once. Scores beyond 62 bits are
    cut there. Other columns are not read; an empty table gives no rows, and so does one without anchors.
    """
    spark = rows.sparkSession
    ddl = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    vectors = materialize(whole_vectors(rows, id_col, vector_col, label_col, scale), "vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    anchors = materialize(vectors.filter(is_anchor).distinct(), "anchors")
    done = []
    for block in anchor_blocks(anchors, max(1, anchor_bytes // (8 * (width + 2 * positives + 2)))) if width else ():
        ids, labels = (block.column(c).to_numpy() for c in ("id", "label"))
        own = matrix(block.column("v").combine_chunks(), width)
        every = np.full((len(ids), 1), 1 << 62)
        shared = spark.sparkContext.broadcast((ids, labels, own, -every, every))
        found = _best_rows(vectors, shared, True, positives, list_rows).toArrow()      # at most `positives` rows an anchor
        shared.destroy()
        pair = np.zeros((len(ids), positives, 2), object)
        least, most = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        known = []
        for a, i, s, place in zip(*(found.column(c).to_pylist() for c in ("anchor", "id", "score", "place"))):
            pair[a, place - 1] = (i, s)
            least[a, place - 1], most[a, place - 1] = -(-low * s // 100), high * s // 100
            known.append((a, place - 1, int(ids[a]), i, s))
        shared = spark.sparkContext.broadcast((ids, labels, own, least, most))
        names = spark.createDataFrame(pa.table({c: pa.array(x, pa.int64()) for c, x in zip(
            ("anchor", "win", "anchor_id", "positive_id", "positive_score"), zip(*known) if known else [[]] * 5)}))
        best = _best_rows(vectors, shared, False, negatives, list_rows)
        done.append(materialize(best.join(names, ["anchor", "win"]).select(
            "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")), "negatives"))
        shared.destroy()
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], ddl)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", noisy), F.col("id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
