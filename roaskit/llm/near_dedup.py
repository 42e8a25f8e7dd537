"""Near-duplicate documents by bottom-k sketches.

A document is its set of distinct 5-word shingles, and one hash function orders all
shingles. Its sketch is the `K` smallest hashes of the set. Inverted lists, one for each
two neighbouring retained values, generate overlaps: where two sets are at least 0.75
alike, the K smallest hashes of their union hold two neighbours that both sets share but
for a chance of 0.58**K (3e-12), and always if the sets have no more than K shingles. The
sketch of the union then estimates the resemblance and filters, and full sets verify.

Equal sets are one class from the start. Every list first yields a star: its members
against its first member, as many pairs as entries. What that links becomes components;
after it, only members of different components are paired, in lists of at most `LIST`
members. What longer lists hold is worked off by exact prefixes (see `long_list_pairs`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roaskit.llm.common import byte_values, bytes_of, id_and_text, mixed, run_hashes, slices, table, without, word_runs
from roaskit.llm.components import components
from roaskit.sources.storage import materialize

WORDS, K = 5, 48
#: Least estimate that is verified: a pair of exactly 0.75 falls below it with a chance of 5e-13.
ESTIMATE = 13 / K
#: Members of a list that is paired at once, and shingles of a block of a longer one (a task holds two blocks, about 4 MB).
LIST, BLOCK_SHINGLES = 32, 1 << 18

_VALUES = byte_values(7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct shingles of each text in ascending order, and where each text's begin (one more than texts)."""
    raw, offsets = bytes_of(column)
    starts, ends, first = word_runs(~_SPACE[raw], offsets)
    words = run_hashes(_VALUES[_LOWER[raw]], starts, ends)
    counts = np.diff(first)
    rows = len(counts)
    if len(words) >= WORDS:
        five = np.zeros(len(words) - WORDS + 1, np.uint64)
        for j in range(WORDS):
            five = five * np.uint64(0x9E3779B97F4A7C15) + words[j:len(words) - WORDS + 1 + j]
        owner = np.repeat(np.arange(rows), counts)
        whole = owner[:len(five)] == owner[WORDS - 1:]
        hashes, row = mixed(five[whole] + np.uint64(WORDS)), owner[:len(five)][whole]
    else:
        hashes, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        joined = np.zeros(len(short), np.uint64)
        for j in range(WORDS - 1):
            has = counts[short] > j
            joined[has] = joined[has] * np.uint64(0x9E3779B97F4A7C15) + words[first[short[has]] + j]
        hashes, row = np.r_[hashes, mixed(joined + counts[short].astype(np.uint64))], np.r_[row, short]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(rows + 1))


def sketches(docs: DataFrame) -> DataFrame:
    """_id, n (shingles), set1 and set2 (a 128-bit hash of the set) and sketch of each row of (_id, _text)."""
    schema = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, first = shingle_sets(part.column("_text"))
                n = np.diff(first)
                size = np.minimum(n, K)
                at = np.repeat(first[:-1] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                sums = [np.r_[np.uint64(0), np.cumsum(mixed(hashes + np.uint64(salt)))] for salt in (1, 2)]
                sketch = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(hashes[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(n), *(pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64)) for s in sums), sketch], schema=schema)

    return docs.mapInArrow(task, "_id long, n long, set1 long, set2 long, sketch array<long>")


def lists(nodes: DataFrame) -> DataFrame:
    """key, id and n: an entry for each two neighbouring values of a sketch; the only value of a sketch of one."""
    key = F.expr("transform(sequence(0, greatest(size(sketch) - 2, 0)), i -> xxhash64(sketch[i], coalesce(get(sketch, i + 1), 0L)))")
    return nodes.select(F.col("_id").alias("id"), "n", F.explode(F.array_distinct(key)).alias("key"))


def fits(n1: Column, n2: Column) -> Column:
    """Whether sets of these sizes can be 0.75 alike."""
    return (4 * n1 >= 3 * n2) & (4 * n2 >= 3 * n1)


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketch of the union doesn't rule out: of its K smallest values (all, if it has fewer) the part in both sets."""
    one, other = (nodes.select(F.col("_id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                keep.append(estimate(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)) >= ESTIMATE)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(other, "b").select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long").distinct()


def estimate(x: np.ndarray, y: np.ndarray) -> float:
    """The resemblance by the sketch of the union of two sketches."""
    both = np.concatenate([x, y])
    both.sort()
    twice = both[1:] == both[:-1]
    union = len(both) - int(twice.sum())
    if union > K:                                     # up to the K-th value of the union
        last = both[np.r_[True, ~twice]][K - 1]
        return float((twice & (both[1:] <= last)).sum()) / K
    return float(twice.sum()) / union if union else 0.0


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are 0.75 alike: 100 * intersection >= 75 * union.

    Both joins are sort-merge joins on ids, so the pairs of a document that has many can be split.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "tb"):
                other, first = shingle_sets(part.column("tb"))
                keep = []
                for i, a in enumerate(part.column("a").to_pylist()):
                    text = part.column("ta")[i]
                    if (a, len(text.as_buffer())) != seen:  # the pairs of one document follow each other
                        mine, seen = shingle_sets(pa.array([text.as_py()]))[0], (a, len(text.as_buffer()))
                    y = other[first[i]:first[i + 1]]
                    common = len(np.intersect1d(mine, y, assume_unique=True))
                    keep.append(100 * common >= 75 * (len(mine) + len(y) - common) and common > 0)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.filter("_id is not null")
    of_b = pairs.join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("tb")), "b")
    both = of_b.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(task, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Texts without words have no shingles and are linked with nothing. A row without an id
    has no component and is kept. Rows that share an id are one document, linked if one of
    them is. Other columns are not read; an empty table gives no rows.
    """
    texts = id_and_text(docs, id_col, text_col)
    sets = materialize(sketches(texts), "sketches")
    whole = sets.filter("n > 0 and _id is not null")
    by_set = ["set1", "set2", "n"]
    # What is joined with many rows of a key is a table, so adaptive execution can split the join.
    classes = materialize(whole.groupBy(*by_set).agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
    firsts = classes.select(F.col("first").alias("_id"), *by_set)
    nodes = materialize(whole.join(firsts, ["_id", *by_set], "left_semi").select("_id", "n", "sketch").distinct(), "classes")
    same = whole.join(classes.filter("copies > 1").drop("copies"), by_set).filter("_id <> first").select(F.col("first").alias("a"), F.col("_id").alias("b"))
    same = materialize(same, "equal-sets")

    entries = lists(nodes)
    heads = materialize(entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("head"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "heads")
    shared = materialize(entries.join(heads, "key").select("key", "id", "n", "head", "members"), "lists")

    star = shared.filter(F.col("id") != F.col("head.id")).filter(fits(F.col("n"), F.col("head.n")))
    stars = materialize(alike(star.select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct(), nodes), "star-pairs")
    links = materialize(verified(stars, texts), "links")

    labels = components(links)
    placed = materialize(shared.join(labels, F.col("id") == F.col("node"), "left").select("key", "id", "n", "members", F.coalesce("label", "id").alias("label")), "lists")
    rest = materialize(alike(short_list_pairs(placed), nodes).join(stars, ["a", "b"], "left_anti"), "other-pairs")
    more = materialize(verified(rest, texts).unionByName(long_list_pairs(placed, texts)), "links")

    final = components(links.unionByName(more).unionByName(same))
    return (sets.join(final, F.col("_id") == F.col("node"), "left")
            .select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "_id").alias("component_id"),
                    F.coalesce("label", "_id").eqNullSafe(F.col("_id")).alias("kept")))


def _sides(entries: DataFrame) -> DataFrame:
    """Pairs of entries of one list that are of different components and can be alike, the smaller id first."""
    a, b = entries.alias("x"), entries.alias("y")
    return a.join(b, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label"))
                  & fits(F.col("x.n"), F.col("y.n"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def short_list_pairs(placed: DataFrame) -> DataFrame:
    """Pairs across components within lists of at most LIST members."""
    several = (placed.filter(F.col("members") <= LIST).groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
               .filter("low <> high").select("key"))
    return _sides(placed.join(several, "key").select("key", "id", "n", "label")).distinct()


def long_list_pairs(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) across components that only long lists could show, enough of them to join what belongs together.

    It takes the documents with over a quarter of their entries in long lists (the others meet
    their partners in short ones), if such a list spans several components. Among these,
    full sets are compared by exact prefixes: with shingles from rare to common, two sets
    0.75 alike share one of the first n - ceil(0.75 n) + 1. Shingles that no other has fill
    up the prefix first, so a document of a large group drops out unless it can have a link.
    What short prefix lists pair is verified like other pairs; long ones are compared in
    blocks, whose tasks hold the sets of two blocks. A list of w shingles in all copies each
    member w / BLOCK_SHINGLES times.
    """
    long_list = F.col("members") > LIST
    spans = (placed.filter(long_list).groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
             .filter("low <> high").select("key", F.lit(True).alias("open")))
    share = (placed.join(spans, "key", "left").groupBy("id").agg(F.sum(long_list.cast("int")).alias("long"), F.first("n").alias("n"),
             F.first("label").alias("label"), F.count("open").alias("open"))
             .filter((F.col("open") > 0) & (4 * F.col("long") > F.least(F.col("n"), F.lit(K)) - 1)))
    chosen = materialize(share.select("id", "label"), "long-list-documents")
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("set", pa.list_(pa.int64()))])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, first = shingle_sets(part.column("_text"))
                sets = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), sets], schema=schema)

    sets = materialize(texts.join(chosen, F.col("_id") == F.col("id")).select("id", "label", "_text")
                       .mapInArrow(to_sets, "id long, label long, set array<long>"), "long-list-sets")
    token = sets.select("id", "label", F.size("set").alias("n"), F.explode("set").alias("key"))
    common = token.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    room = F.col("n") - F.ceil(0.75 * F.col("n")) + 1 - (F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("id")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("members", "key"))
    prefix = (token.join(common, "key").withColumn("room", room).filter("room > 0").withColumn("place", place).filter("place <= room")
              .select("key", "id", "n", "label"))
    prefix = materialize(prefix, "prefixes")
    several = (prefix.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"), F.min("label").alias("low"), F.max("label").alias("high"),
               *[F.sum(F.xxhash64("id", F.lit(salt)).cast("decimal(38,0)")).alias(f"whole{salt}") for salt in (1, 2)]).filter("low <> high")
               .groupBy("members", "weight", "whole1", "whole2").agg(F.min("key").alias("key")))  # lists of the same members count once
    open_lists = materialize(prefix.join(several.select("key", "members", "weight"), "key"), "prefix-lists")
    short = verified(_sides(open_lists.filter(F.col("members") <= LIST)).distinct(), texts)

    blocks = F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    entry = (open_lists.filter(long_list).withColumn("blocks", blocks).withColumn("mine", mine)
             .select("key", "id", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")))
    dealt = entry.select("key", "id", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).join(sets, "id")
    long = dealt.select("key", "i", "j", "mine", "id", "label", "set").groupBy("key", "i", "j").applyInArrow(links_of_blocks, "a long, b long")
    return short.unionByName(long).distinct()


def links_of_blocks(group: pa.Table) -> pa.Table:
    """Links between the documents of block i and block j, up to what joins their components."""
    i, j, mine = (group.column(c).to_numpy() for c in ("i", "j", "mine"))
    ids, labels = group.column("id").to_numpy(), group.column("label").to_numpy()
    each = [np.asarray(x.values.to_numpy()) for x in group.column("set")]
    n = np.array([len(x) for x in each])
    rows, cols = (np.flatnonzero(mine == (i if side == 0 else j)) for side in (0, 1))
    values, place = np.unique(np.concatenate(each), return_inverse=True)
    owner = np.repeat(np.arange(len(each)), n)
    inter = np.zeros((len(rows), len(cols)), np.float32)
    step = max(64, (16 << 20) // (4 * len(each)))     # columns at a time: 16 MB
    for low in range(0, len(values), step):
        near = (place >= low) & (place < low + step)
        dense = np.zeros((len(each), min(step, len(values) - low)), np.float32)
        dense[owner[near], place[near] - low] = 1
        inter += dense[rows] @ dense[cols].T
    alike = (100 * inter >= 75 * (n[rows][:, None] + n[cols][None] - inter)) & (labels[rows][:, None] != labels[cols][None]) & (ids[rows][:, None] != ids[cols][None])
    joined: dict[int, int] = {}

    def top(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    out = []
    for r, c in zip(*np.nonzero(alike)):
        x, y = top(int(labels[rows[r]])), top(int(labels[cols[c]]))
        if x != y:
            joined[max(x, y)] = min(x, y)
            out.append((int(min(ids[rows[r]], ids[cols[c]])), int(max(ids[rows[r]], ids[cols[c]]))))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with their columns, that stay: of each group the smallest id; rows without an id stay.

    Rows that share an id are one document here, and go or stay together. Other columns may
    have any name; an empty table gives no rows.
    """
    return without(docs, near_groups(docs).filter("not kept").select(F.col("doc_id").alias("_id")), "doc_id")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
