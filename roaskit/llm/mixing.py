"""Mixing of sources to target weights by the cube method.

A source's target over its size is how often each of its documents is expected in the
mix: its whole part is given to all, the fraction is an inclusion probability. The flight
moves probabilities along the null space of the constraints, the words and the documents
taken, until one of three becomes 0 or 1; so both totals keep while documents are decided.
It runs over salted buckets of documents, each source and size class (powers of two) for
itself, and leaves at most two documents open in each. What is open meets in fewer buckets
from round to round; at the end a source has at most two open documents a size class, and
the landing decides these, the largest first, each to the side that keeps the words taken
nearest to the target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit.functions.attach import attach
from roaskit.llm.common import SPACE, bytes_of, mixed, slices, table, word_runs
from roaskit.operators.ordered import running_totals
from roaskit.sources.storage import materialize

#: Weights of the sources in their order, over and over; words of the mix for each word there is; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents of a bucket, about, and buckets that become one in the next round.
BUCKET, FAN_IN = 1 << 14, 64

_UNITS = "id long, source string, place long, size long, source_size long, target double, h long, bucket long, level int, whole long, p double"


def document_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size (words) and h (a hash of the row) of every row."""
    schema = pa.schema([("id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("h", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, offsets = bytes_of(part.column("_text"))
                words = np.diff(word_runs(~SPACE[raw], offsets)[2])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("source").cast(pa.string()), pa.array(words, pa.int64()), part.column("h")], schema=schema)

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), text.alias("_text"),
                       F.xxhash64(F.col(id_col).cast("long"), F.col(source_col).cast("string"), text).alias("h"))
    return rows.mapInArrow(task, "id long, source string, size long, h long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, place (1 for the first by code point, null last), source_size and target of each source.

    Targets are weight * level, at most `most` times the size, and come to `share` of all
    sizes. With sources by falling weight for what they have, the level is the greatest of
    (what the sources before leave of the mix) / (weights not before), as it rises while
    sources are full and falls after. Only this number comes to the driver.
    """
    sums = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    placed = running_totals(sums, [F.col("source").isNull(), F.coalesce("source", F.lit(""))], {}, "place")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = materialize(placed.withColumn("weight", pick).withColumn("full", F.col("source_size") * F.lit(most)), "sources")
    filled = running_totals(placed, [F.col("full") / F.col("weight"), F.col("place")], {"full_sum": "full", "weight_sum": "weight"}, "_rank")
    total = placed.agg((F.sum("source_size") * F.lit(float(share))).alias("mix"), F.sum("weight").alias("weights"))
    level = attach(filled, total, "mix", "weights").agg(
        F.max((F.col("mix") - (F.col("full_sum") - F.col("full"))) / (F.col("weights") - (F.col("weight_sum") - F.col("weight")))).alias("level"))
    return attach(placed, level, "level").select("source", "place", "source_size",
                                                 F.least(F.col("full").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def moved(p: list[float], size: list[int], draw: float) -> list[float]:
    """Three probabilities (or two of one size) moved along the null space of the constraints (1, size), until one is 0 or 1."""
    if len(p) == 3 and not size[0] == size[1] == size[2]:
        way = [size[1] - size[2], size[2] - size[0], size[0] - size[1]]
    else:
        way = [1, -1, 0][:len(p)]
    on = min((1 - x) / w if w > 0 else x / -w for x, w in zip(p, way) if w)
    back = min(x / w if w > 0 else (1 - x) / -w for x, w in zip(p, way) if w)
    step = on if draw * (on + back) < back else -back
    out = [x + step * w for x, w in zip(p, way)]
    return [0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x for x in out]


class Flight:
    """The flight over a stream of units: those of one group follow each other; at most two are open at a time."""

    def __init__(self):
        self.group, self.open = None, []

    def over(self, groups: list, sizes: list, p: list, draws: list) -> list[float]:
        """The probabilities after the flight; `open` has the places of those left open in the last group."""
        p = list(p)
        for i, group in enumerate(groups):
            if group != self.group:
                self.group, self.open = group, []
            if 0 < p[i] < 1:
                self.open.append(i)
                while len(self.open) == 3 or len(self.open) == 2 and sizes[self.open[0]] == sizes[self.open[1]]:
                    after = moved([p[j] for j in self.open], [sizes[j] for j in self.open], draws[i])
                    for j, x in zip(self.open, after):
                        p[j] = x
                    self.open = [j for j in self.open if 0 < p[j] < 1]
        return p


def _with_p(units: pa.Table, p: list[float]) -> pa.Table:
    at = units.schema.get_field_index("p")
    return units.set_column(at, units.schema.field(at), pa.array(p, pa.float64()))


def _flown(batches: Iterator[pa.RecordBatch], keys: list[str], salt: int) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted stream after the flight; what a batch leaves open in its last group meets the next batch."""
    held, flight = None, Flight()
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        whole = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        flight.group, flight.open = None, []
        draws = (mixed(whole.column("h").to_numpy().view(np.uint64) + np.uint64(salt)) >> np.uint64(11)) / float(1 << 53)
        groups = list(zip(*(whole.column(k).to_pylist() for k in keys)))
        p = flight.over(groups, whole.column("size").to_pylist(), whole.column("p").to_pylist(), draws.tolist())
        whole = _with_p(whole, p)
        stay = np.zeros(len(whole), bool)
        stay[flight.open] = True
        held = whole.filter(pa.array(stay))
        yield from whole.filter(pa.array(~stay)).to_batches()
    if held is not None:
        yield from held.to_batches()


def landed(sizes: list[int], p: list[float]) -> list[float]:
    """The landing of one source: from the largest open unit on, each to the side that keeps the sum of words nearest to its expectation."""
    out, ahead = list(p), 0.0
    for i in sorted((i for i, x in enumerate(p) if 0 < x < 1), key=lambda i: -sizes[i]):
        up, down = ahead + (1 - p[i]) * sizes[i], ahead - p[i] * sizes[i]
        out[i], ahead = (1.0, up) if (abs(up), p[i] < 0.5) < (abs(down), p[i] >= 0.5) else (0.0, down)
    return out


def _landed_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream sorted by source and size class: the last flight, then the landing of each source."""
    held: pa.Table | None = None
    for batch in _flown(batches, ["place", "level"], 0):
        p = batch.column("p").to_numpy()
        unsure = (p > 0) & (p < 1)
        yield batch.filter(pa.array(~unsure))
        left = pa.Table.from_batches([batch.filter(pa.array(unsure))])
        held = (left if held is None else pa.concat_tables([held, left])).combine_chunks()
        places = held.column("place").to_numpy()
        last = places == places[-1] if len(places) else np.zeros(0, bool)
        yield from _landing(held.filter(pa.array(~last)))
        held = held.filter(pa.array(last))
    if held is not None:
        yield from _landing(held)


def _landing(units: pa.Table) -> Iterator[pa.RecordBatch]:
    place, sizes, p = (units.column(c).to_pylist() for c in ("place", "size", "p"))
    out = list(p)
    for one in dict.fromkeys(place):
        mine = [i for i, x in enumerate(place) if x == one]
        for i, x in zip(mine, landed([sizes[i] for i in mine], [p[i] for i in mine])):
            out[i] = x
    yield from _with_p(units, out).to_batches()


def mixed_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
                  share: float = SHARE, most: int = MOST, bucket_rows: int = BUCKET, fan_in: int = FAN_IN) -> DataFrame:
    """id, source, size, source_size, target, copies and taken (size * copies) of every row.

    Draws come from a hash of the row, and buckets and orders from its values, so a run again
    gives the same result however the rows lie. A null text has no words, a null source is a
    source, ids may be null; rows that repeat another one are documents of their own, and as
    they can't be told apart, which of them are taken is no difference. A source without words
    has the target 0 and none of its documents is taken. Other columns are not read; an empty
    table gives no rows. Needs 0 <= share <= most.
    """
    if not 0 <= share <= most or min(weights) <= 0:
        raise ValueError("the share is from 0 to the most copies, and weights are positive")
    sizes = materialize(document_sizes(docs, id_col, text_col, source_col), "sizes")
    targets = materialize(source_targets(sizes, weights, share, most), "targets")
    buckets = max(1, -(-sizes.count() // bucket_rows))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("rate") + 1e-12)
    part = F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))
    units = (sizes.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
             .join(targets.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).drop("source"), "key")
             .withColumn("rate", rate).withColumn("whole", whole)
             .select("id", "source", "place", "size", "source_size", "target", "h", F.pmod("h", F.lit(buckets)).alias("bucket"),
                     F.length(F.bin("size")).cast("int").alias("level"), "whole", F.when(part < 1e-12, 0.0).otherwise(part).alias("p")))
    done, salt = [], 1
    keys = ["bucket", "place", "level"]
    order = [F.desc("size"), "h", "id"]
    unsure = (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        def task(batches: Iterator[pa.RecordBatch], salt: int = salt) -> Iterator[pa.RecordBatch]:
            return _flown(batches, keys, salt)

        flown = materialize(units.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(task, _UNITS), "flown")
        done.append(flown.filter(~unsure))
        units = flown.filter(unsure)
        if buckets <= fan_in:
            break
        buckets, salt = -(-buckets // fan_in), salt + 1
        units = units.withColumn("bucket", F.floor(F.col("bucket") / fan_in))
    last = units.repartition("place").sortWithinPartitions("place", "level", *order).mapInArrow(_landed_stream, _UNITS)
    done.append(materialize(last, "landed"))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    copies = F.col("whole") + F.col("p").cast("long")
    return every.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed_sources(table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "source")
