"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word has a fixed sparse index vector of +1 and -1, drawn from its hash; its word
vector is the sum of the index vectors around it in the training texts. So has its shape
(case, digits and signs, without length). A document pools the vectors of all its words,
and the products of neighbouring index vectors, which show words that repeat. A network of
two layers in numpy gives a logit; one temperature, fitted on rows left out of the
training, turns it into a calibrated probability.

The model is learned on a bounded sample of labelled rows (`SAMPLE_ROWS`); every whole text
is scored. Its size depends on the parameters alone.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit.llm.common import bytes_of, byte_values, id_and_text, mixed, plain_text, run_hashes, slices, smallest_hashes, table, without, word_runs

#: Bound of what is learned from: labelled rows, each with its whole text.
SAMPLE_ROWS = 4000
#: Rows of the vector tables (words by hash, then shapes), length of a vector, words on each side that count.
WORD_ROWS, SHAPE_ROWS, DIM, WINDOW = 1 << 15, 1 << 12, 32, 2
#: Words of the short runs that are learned from beside whole texts.
SHORT = (3, 40)
HIDDEN, EPOCHS, BATCH, RATE, DECAY, LEFT_OUT = 32, 60, 64, 3e-3, 1e-3, 0.2
THRESHOLD = 0.3
#: Score of every text where nothing could be learned.
UNKNOWN = 0.5
POOL_BYTES = 1 << 20

_WORD_VALUES, _SHAPE_VALUES = byte_values(6), byte_values(60)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: A byte's class in a shape; 0 for bytes beyond ASCII, which leave no trace.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 0


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the words and of their shapes in all texts, and each text's first word (one more than texts)."""
    raw, offsets = bytes_of(column)
    starts, ends, first = word_runs(~_SPACE[raw], offsets)
    words = (run_hashes(_WORD_VALUES[raw], starts, ends) % np.uint64(WORD_ROWS)).astype(np.int64)
    kind = _CLASS[raw]
    at = np.flatnonzero((kind > 0) & ~_SPACE[raw])
    word = np.searchsorted(starts, at, "right")
    new = np.ones(len(at), bool)
    new[1:] = (kind[at[1:]] != kind[at[:-1]]) | (word[1:] != word[:-1])
    kept = at[new]
    shape = run_hashes(_SHAPE_VALUES[kind[kept]], np.searchsorted(kept, starts), np.searchsorted(kept, ends))
    return words, (shape % np.uint64(SHAPE_ROWS)).astype(np.int64) + WORD_ROWS, first


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, an eighth of each not 0, drawn from the row's number."""
    n = (WORD_ROWS + SHAPE_ROWS) * DIM
    drawn = mixed(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(60)
    return np.where(drawn == 0, 1.0, np.where(drawn == 1, -1.0, 0.0)).astype(np.float32).reshape(-1, DIM)


def word_vectors(texts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The table of word vectors: sums of the index vectors around, scaled to length 1; an unseen row has its index vector."""
    index, sums = index_vectors(), np.zeros((WORD_ROWS + SHAPE_ROWS, DIM), np.float32)
    for words, shapes, first in texts:
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for by in range(1, WINDOW + 1):
            same = owner[by:] == owner[:-by]
            for terms in (words, shapes):
                a, b = terms[:-by][same], terms[by:][same]
                np.add.at(sums, a, index[b])
                np.add.at(sums, b, index[a])
    sums = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, sums, index)
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)


def pooled(vectors: np.ndarray, index: np.ndarray, words: np.ndarray, shapes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of features for each text; zeros and a size of 0 for a text without words."""
    n = np.diff(first)
    full, out = np.flatnonzero(n), np.zeros((len(n), 5 * DIM + 2), np.float32)
    if len(full):
        at, count = first[:-1][full], n[full][:, None].astype(np.float32)

        def mean(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, at, axis=0, dtype=np.float32) / count

        ahead = np.r_[words[1:], words[-1:]]
        ahead[first[1:][full] - 1] = words[first[1:][full] - 1]  # the last word of a text has no neighbour
        v = vectors[words]
        i = index[words]
        m = mean(v)
        s = vectors[shapes]
        out[full, :5 * DIM] = np.hstack([m, np.sqrt(np.maximum(mean(v * v) - m * m, 0)), mean(s), np.maximum.reduceat(s, at, axis=0), mean(i * index[ahead]) * 4])
        out[full, 5 * DIM] = np.log1p(count[:, 0]) / 8
    out[:, 5 * DIM + 1] = n == 0
    return out


class Network:
    """Two layers over standardized features, and a temperature."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, left_out: np.ndarray) -> Network:
    """Adam on the log loss with weight decay; the temperature is fitted on the rows left out."""
    rng = np.random.default_rng(1)
    train = np.flatnonzero(~left_out)
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    z, target = ((x - mean) / scale).astype(np.float64), y.astype(np.float64)
    p = {"w1": rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), "b2": np.zeros(())}
    slow, fast, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for a in range(0, len(order), BATCH):
            rows = order[a:a + BATCH]
            hidden = np.maximum(z[rows] @ p["w1"] + p["b1"], 0)
            off = (1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"], -30, 30))) - target[rows]) / len(rows)
            back = np.outer(off, p["w2"]) * (hidden > 0)
            grads = {"w1": z[rows].T @ back, "b1": back.sum(axis=0), "w2": hidden.T @ off, "b2": off.sum()}
            step += 1
            for k, g in grads.items():
                slow[k] = 0.9 * slow[k] + 0.1 * g
                fast[k] = 0.999 * fast[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (slow[k] / (1 - 0.9 ** step) / (np.sqrt(fast[k] / (1 - 0.999 ** step)) + 1e-8) + (DECAY * p[k] if k[0] == "w" else 0))
    net = Network(p | {"mean": mean, "scale": scale, "temperature": np.array(1.0)})
    held = np.flatnonzero(left_out)
    if len(held) and 0 < y[held].sum() < len(held):
        logits, best = net.logits(x[held]), (np.inf, 1.0)
        for t in np.exp(np.linspace(np.log(0.25), np.log(8), 60)):
            s = np.clip(1 / (1 + np.exp(-np.clip(logits / t, -30, 30))), 1e-6, 1 - 1e-6)
            best = min(best, (float(-np.mean(np.where(y[held] == 1, np.log(s), np.log(1 - s)))), float(t)))
        net.temperature = np.array(best[1])
    return net


def train(texts: list[pa.Array], labels: np.ndarray, left_out: np.ndarray) -> bytes:
    """The model of some labelled texts: the vector table and the network, as bytes of bounded size.

    A short run of words of each good text is learned from as well, for short texts are few.
    """
    terms = [terms_of(t) for t in texts]
    vectors, index = word_vectors(iter(terms)).astype(np.float32), index_vectors()
    places = np.cumsum([0] + [len(t) for t in texts])
    rng, features, of = np.random.default_rng(2), [pooled(vectors, index, *t) for t in terms], [np.arange(len(labels))]
    for (words, shapes, first), a, b in zip(terms, places[:-1], places[1:]):
        good = np.flatnonzero((labels[a:b] == 1) & (np.diff(first) > SHORT[0]))
        size = np.minimum(rng.integers(*SHORT, len(good)), np.diff(first)[good])
        start = first[good] + (rng.random(len(good)) * (np.diff(first)[good] - size + 1)).astype(int)
        at = np.concatenate([np.arange(x, x + n) for x, n in zip(start, size)] or [np.zeros(0, int)])
        features.append(pooled(vectors, index, words[at], shapes[at], np.r_[0, np.cumsum(size)]))
        of.append(a + good)
    rows = np.concatenate(of)
    net = fit_network(np.concatenate(features), labels[rows], left_out[rows])
    out = io.BytesIO()
    np.savez_compressed(out, vectors=vectors.astype(np.float16), **{k: np.asarray(v, np.float32) for k, v in vars(net).items()})
    return out.getvalue()


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_ROWS) -> bytes:
    """The model learned from `most` labelled rows at most, none of them held out.

    Which rows are taken depends on a hash of their ids. Labels that repeat are averaged;
    those without an id, a quality or a row of `docs` are passed over. Without rows of both
    qualities there is nothing to learn: the model is empty, and all texts score `UNKNOWN`.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_q")).dropna()
             .groupBy("_id").agg((F.avg("_q") >= 0.5).cast("int").alias("_label")).filter(~is_held_out(F.col("_id"))))
    marked = smallest_hashes(known, F.col("_id"), most)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(marked), "_id")  # `most` rows at most
    sample = (rows.withColumn("_left_out", F.pmod(F.xxhash64("_id", F.lit("left out")), F.lit(1000)) < F.lit(int(1000 * LEFT_OUT)))
              .repartition(1).sortWithinPartitions("_id", "_text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, held, seen = [], [], [], set()
        for batch in batches:
            for part in slices(batch, most=POOL_BYTES):
                fresh = [i for i, d in enumerate(part.column("_id").to_pylist()) if not (d in seen or seen.add(d))]  # a row for an id
                part = part.take(pa.array(fresh, pa.int32()))
                texts.append(part.column("_text"))
                marks += part.column("_label").to_pylist()
                held += part.column("_left_out").to_pylist()
        if 0 < sum(marks) < len(marks):
            yield pa.RecordBatch.from_pydict({"model": pa.array([train(texts, np.array(marks), np.array(held))], pa.binary())})

    got = sample.mapInArrow(task, "model binary").collect()          # one row of bounded size
    return bytes(got[0].model) if got else b""


def scored(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; the text alone makes the score.

    A null text counts as empty; all texts without words share one score. Rows stay as they
    are, repeated ones and those without an id too; other columns are not read. An empty model
    scores every text `UNKNOWN`; an empty table gives no rows.
    """
    rows = scored_keys(id_and_text(docs, id_col, text_col).withColumn("_key", F.lit(0).cast("long")), model)
    return rows.select(F.col("_id").alias("doc_id"), is_held_out(F.col("_id")).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def scored_keys(texts: DataFrame, model: bytes) -> DataFrame:
    """_id, _key and score of rows of _id, _key and _text."""
    schema = pa.schema([("_id", pa.int64()), ("_key", pa.int64()), ("score", pa.float64())])
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared.value:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(np.full(batch.num_rows, UNKNOWN))], schema=schema)
            return
        arrays = dict(np.load(io.BytesIO(shared.value)))
        vectors, index, net = arrays.pop("vectors").astype(np.float32), index_vectors(), Network(arrays)
        for batch in batches:
            for part in slices(batch, most=POOL_BYTES):
                x = pooled(vectors, index, *terms_of(part.column("_text")))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_key"), pa.array(net.scores(x), pa.float64())], schema=schema)

    return texts.select("_id", "_key", "_text").mapInArrow(task, "_id long, _key long, score double")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, that the classifier does not reject.

    A row is judged by its own text, others of its id by theirs; rows without an id stay. A
    null text is an empty one. Without labels of both qualities nothing is rejected; other
    columns may have any name; an empty table gives no rows.
    """
    model = fitted(docs, labels, id_col, text_col)
    if not model:
        return docs
    keyed = id_and_text(docs, id_col, text_col).withColumn("_key", F.xxhash64("_text"))
    rejected = scored_keys(keyed, model).filter(F.col("score") < THRESHOLD)
    return without(docs, rejected, id_col, F.xxhash64(plain_text(text_col)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
