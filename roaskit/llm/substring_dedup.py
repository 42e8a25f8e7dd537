"""Substring dedup by hashing: of every passage the earliest occurrence stays, and the rest go.

Lines are cut into units (sentences), normalized, and hashed. A passage is the shortest run of
neighbouring units from a place on, or up to a place, that holds `min_words` words; it is hashed
as a whole. Globally, a digest keeps the occurrence of the lowest rank (document id, then place);
every later one is a copy, word by word, of that one place, and goes. So a passage that begins or
ends inside a line is caught, and text put together from sentences of several documents stays.
With `min_words` of 1 every unit is a passage by itself.
Kept and removed ranges carry their offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit.llm.common import id_and_text, run_hashes, slices, table
from roaskit.sources.storage import materialize

#: Words that a passage must hold to count as a copy.
MIN_WORDS = 30
#: Signs left out around a unit.
SIGNS = " .,;:!?\"'()[]*|-"
_END = re.compile(r"\n|(?<![.!?])[.!?]++(?=\s)")


def units_of(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence or rest of a line that isn't blank, white space around it left out."""
    out, at = [], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        unit = text[at:end]
        body = unit.strip()
        if body:
            start = at + len(unit) - len(unit.lstrip())
            out.append((start, start + len(body)))
        at = end
    return out


def digest_of(unit: str) -> tuple[bytes, int]:
    """128 bits of the unit in NFKC, lower case, white space as one space and without signs around; and its words."""
    words = (unit if unit.isascii() else unicodedata.normalize("NFKC", unit)).lower().split()
    return hashlib.blake2b(" ".join(words).strip(SIGNS).encode(), digest_size=16).digest(), len(words)


def passages(words: np.ndarray, of: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end unit of each passage of documents whose units lie one after another.

    `words` has the units' numbers of words, `of` their documents' numbers, ascending.
    """
    n = len(words)
    sums = np.concatenate([[0], np.cumsum(words)])
    start = np.arange(n)
    end = np.searchsorted(sums, sums[:-1] + min_words, "left")
    whole = end <= np.searchsorted(of, of, "right")
    back_end = start + 1
    back = np.searchsorted(sums, sums[1:] - min_words, "right") - 1
    other = back >= np.searchsorted(of, of, "left")
    other &= end[np.maximum(back, 0)] != back_end  # that one is there already, from its start on
    return np.concatenate([start[whole], back[other]]), np.concatenate([end[whole], back_end[other]])


def passage_table(docs: DataFrame, min_words: int) -> DataFrame:
    """_id, _row (a hash of the text, for rows that share an id), at (first unit's place in the text, from 0), n (units), digest of every passage."""
    schema = pa.schema([("_id", pa.int64()), ("_row", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                of, digests, words = [], [], []
                for i, text in enumerate(part.column("_text").to_pylist()):
                    found = [digest_of(text[a:b]) for a, b in units_of(text)]
                    of += [i] * len(found)
                    digests += [d for d, _ in found]
                    words += [w for _, w in found]
                if not of:
                    continue
                docs_of = np.array(of)
                start, end = passages(np.array(words), docs_of, min_words)
                halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
                whole = np.stack([run_hashes(halves[:, k], start, end) for k in (0, 1)], axis=1)
                offsets = np.arange(len(start) + 1, dtype=np.int32) * 16
                rows = pa.array(docs_of[start])
                at = start - np.searchsorted(docs_of, docs_of[start], "left")
                yield pa.RecordBatch.from_arrays([
                    part.column("_id").take(rows), part.column("_row").take(rows), pa.array(at, pa.int32()), pa.array(end - start, pa.int32()),
                    pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(whole))])], schema=schema)

    return docs.mapInArrow(task, "_id long, _row long, at int, n int, digest binary")


def copied_passages(docs: DataFrame, min_words: int) -> DataFrame:
    """_id, _row, copies: for each document with copied passages a list of (at, n, keep_id), in the order of the text.

    The lowest rank of a digest is a partial minimum before the shuffle. Only digests that
    occur again are joined back, a row each, to the passages.
    """
    every = passage_table(docs, min_words)
    rank = F.struct(F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("at").alias("at"))
    first = materialize(every.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                        .select("digest", "first"), "first-passages")  # a table, so that the join may split a digest that very many places have
    copies = every.join(first, "digest").filter(rank != F.col("first"))
    one = F.struct("at", "n", F.col("first.id").alias("keep_id"))
    return materialize(copies.groupBy("_id", "_row").agg(F.sort_array(F.collect_list(one)).alias("copies")), "copied-passages")


def cut(text: str, copies: list[dict]) -> tuple[str, list[dict], list[dict]]:
    """The text without its copied passages, the removed ranges and the kept ones, in code points of the original.

    Passages that overlap or stand side by side go as one range.
    """
    units = units_of(text) if copies else []
    removed: list[dict] = []
    until = -1
    for c in copies:  # in the order of their first units
        start, end = units[c["at"]][0], units[c["at"] + c["n"] - 1][1]
        if c["at"] <= until:
            removed[-1]["end"] = max(removed[-1]["end"], end)
            removed[-1]["keep_ids"].add(c["keep_id"])
        else:
            removed.append({"start": start, "end": end, "keep_ids": {c["keep_id"]}})
        until = max(until, c["at"] + c["n"])
    for r in removed:
        r["keep_ids"] = sorted(r["keep_ids"])
    parts, kept, at = [], [], 0
    for r in [*removed, {"start": len(text), "end": len(text)}]:
        if r["start"] > at:
            parts.append(text[at:r["start"]])
            kept.append({"start": at, "end": r["start"]})
        at = r["end"]
    return "".join(parts), removed, kept


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text, n_removed, removed_chars, removed (start, end, keep_ids) and kept (start, end) of every row.

    A null text stays null. A row without an id is passed on unchanged, and nothing is a copy
    of it. Rows that share an id and a text count as one occurrence, so repeated rows come out
    alike; rows that share only the id rank by a hash of their texts. Other columns are not
    read; an empty table gives no rows.
    """
    texts = id_and_text(docs, id_col, text_col, null_text=None).withColumn("_row", F.xxhash64("_text"))
    copies = copied_passages(texts.dropna(), min_words)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    gone = pa.struct([*span, pa.field("keep_ids", pa.list_(pa.int64()))])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int64()), ("removed_chars", pa.int64()),
                        ("removed", pa.list_(gone)), ("kept", pa.list_(span))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for d, text, found in zip(*(part.column(c).to_pylist() for c in ("_id", "_text", "copies"))):
                    left, removed, kept = cut(text, found or []) if text is not None else (None, [], [])
                    rows.append({"doc_id": d, "text": left, "n_removed": len(removed), "removed_chars": sum(r["end"] - r["start"] for r in removed),
                                 "removed": removed, "kept": kept})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return texts.join(copies, ["_id", "_row"], "left").select("_id", "_text", "copies").mapInArrow(
        task, "doc_id long, text string, n_removed long, removed_chars long, "
              "removed array<struct<start:bigint,end:bigint,keep_ids:array<bigint>>>, kept array<struct<start:bigint,end:bigint>>")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_copies(table(spark, sf_dir, "documents"))
