"""Exact dedup with a heavy-hitter split.

Every text becomes a digest, written once. Misra-Gries summaries of all partitions,
merged, name the digests that may be frequent; these are counted exactly, and the
winners of the frequent ones (at most `counters` rows) are broadcast, so copies of a
text that a third of all rows hold never meet in one task. All other digests are
grouped by an ordinary shuffle, in which no key has more than rows / counters rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit.llm.common import hex_of, id_and_text, plain_text, table, without
from roaskit.sources.storage import materialize

SPACES = r"[\x20\x09-\x0D]+"
#: Counters of a Misra-Gries summary, hence the most rows that are broadcast.
COUNTERS = 256


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with every run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACES, " "), 256))


def _pruned(counts: dict, counters: int) -> dict:
    """A Misra-Gries summary: the (counters + 1)th count is taken off all, and what is left stays."""
    if len(counts) <= counters:
        return counts
    off = sorted(counts.values(), reverse=True)[counters]
    return {k: n - off for k, n in counts.items() if n > off}


def frequent_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests, among them each that more than rows / (counters + 1) rows hold."""
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            for x in pa.compute.value_counts(batch.column(0)).to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            counts = _pruned(counts, counters)
        yield pa.RecordBatch.from_pydict({"digest": list(counts), "n": list(counts.values())},
                                         schema=pa.schema([("digest", pa.binary()), ("n", pa.int64())]))

    parts = digests.select("digest").mapInArrow(summary, "digest binary, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest (binary SHA-256) of every row.

    A null text is an empty one. A row without an id never stays where an equal row has
    one; if none has, keep_id is null and all of them stay. A row that repeats the winner,
    id included, is reported like the winner. Other columns are not read. An empty table
    gives no rows.
    """
    digests = materialize(id_and_text(docs, id_col, text_col).select(
        F.col("_id").alias("doc_id"), text_digest(F.col("_text")).alias("digest")), "digests")
    candidates = [r.digest for r in frequent_candidates(digests, counters).collect()]
    winner = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    chosen = digests.sparkSession.createDataFrame([(bytes(d),) for d in candidates], "digest binary")
    frequent = digests.join(F.broadcast(chosen), "digest", "left_semi").groupBy("digest").agg(*winner)
    heavy = F.broadcast(materialize(frequent, "winners").select("digest", "keep_id", "group_size", F.lit(True).alias("heavy")))
    split = digests.join(heavy, "digest", "left")
    rest = split.filter("heavy is null").select("doc_id", "digest")
    ordinary = rest.join(rest.groupBy("digest").agg(*winner), "digest")
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"]
    return split.filter("heavy").select(*columns).unionByName(ordinary.select(*columns))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, whose text no smaller id has; rows without an id stay.

    Rows of one id stand for themselves, and a row that repeats the winner stays with it. A null
    text is an empty one. Other columns may have any name; an empty table gives no rows.
    """
    dropped = exact_groups(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_key"))
    return without(docs, dropped, id_col, text_digest(plain_text(text_col)))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", hex_of(F.col("digest")).alias("text_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
