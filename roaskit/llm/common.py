"""What the operators of this folder share: reading, binary files in the shared folder, words as arrays."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as arrays at a time; these take about 50 bytes for each.
SLICE_BYTES = 1 << 20
#: Which bytes are white space between words.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str, null_text: str | None = "") -> DataFrame:
    """The id as a long and the text, named _id and _text whatever else the table holds."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("_id"),
                     (text if null_text is None else F.coalesce(text, F.lit(null_text))).alias("_text"))


def without(docs: DataFrame, dropped: DataFrame, id_col: str, key: Column | None = None) -> DataFrame:
    """The rows of `docs`, with their columns, but those that `dropped` names by _id, and _key if `key` (on `docs`) is given.

    With the hash or digest of the text as key a row goes for its own text, and others of its
    id stay. Rows without an id stay. The names that the join brings are none of the table's.
    """
    taken = {c.lower() for c in docs.columns}

    def free(base: str) -> str:
        return next(n for n in (f"{base}{i or ''}" for i in range(len(taken) + 1)) if n not in taken)

    id_name, key_name = free("_gone_id"), free("_gone_key")
    gone = dropped.filter("_id is not null").select(F.col("_id").alias(id_name), *([] if key is None else [F.col("_key").alias(key_name)])).distinct()
    same = F.col(f"`{id_col}`").cast("long") == F.col(id_name)
    return docs.join(gone, same if key is None else same & (key == F.col(key_name)), "left_anti")


def plain_text(text_col: str) -> Column:
    """A text column of a table, null as empty."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def slices(batch: pa.RecordBatch, column: str = "_text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about `most` bytes; a longer row stands alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after another, and where each row starts (one more entry than rows)."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply, twice)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((np.uint64(32), np.uint64(0xD6E8FEB86659FD93)), (np.uint64(29), np.uint64(0x9E3779B97F4A7C15))):
        x ^= x >> shift
        x *= factor
    return x ^ (x >> np.uint64(32))


def byte_values(salt: int) -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


_BASE = 0xB5297A4D3F84D5B5
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, n at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each run, by one prefix sum over all of them."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_runs(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that don't cross a row: starts, ends, and the first run of each row (one more than rows)."""
    edge = np.zeros(len(is_word) + 1, bool)
    edge[offsets] = True
    word = is_word.view(np.int8)
    before, after = np.empty_like(word), np.empty_like(word)
    if len(word):
        before[0], before[1:] = 0, word[:-1]
        after[-1], after[:-1] = 0, word[1:]
    starts = np.flatnonzero((word == 1) & ((before == 0) | edge[:-1]))
    ends = np.flatnonzero((word == 1) & ((after == 0) | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among the ordered ones."""
    if not len(ordered) or not len(values):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder in the shared store, and the path there."""
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Placed:
    """A file of the shared folder that appears under its name only when whole: a task that is run again writes it anew."""

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.draft = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"

    def __enter__(self) -> pa.NativeFile:
        self.out = self.fs.open_output_stream(self.draft)
        return self.out

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.draft, self.path)
        else:
            self.fs.delete_file(self.draft)


def smallest_hashes(df: DataFrame, key: Column, most: int) -> DataFrame:
    """The `most` rows whose key has the smallest hash, with the hash as _order; all rows if there are no more.

    Rows are counted first, and those with a hash beyond what is needed (with room to spare)
    go before the sort, so one task never meets more than a small multiple of `most`.
    """
    hashed = df.withColumn("_order", F.xxhash64(key))
    n = hashed.select("_order").count()
    if n > 2 * most:
        bound = int(-(1 << 63) + (1 << 64) * (1.5 * most + 100) / n)
        near = hashed.filter(F.col("_order") < F.lit(min(bound, (1 << 63) - 1)))
        if near.select("_order").count() >= most:
            hashed = near
    return hashed.orderBy("_order").limit(most)


@contextmanager
def few_cycles() -> Iterator[None]:
    """No search for cycles meanwhile: for code that makes millions of tuples or strings and no cycle."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
