"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of a range of documents. Each block of 256 ids keeps its smallest id
and the differences from it, packed at the width that `SHARE` of them fit in; the high
bits of the others go to an exception list. A block index at the end has where each block
starts, so a reader may begin anywhere. The last block is filled up with its own minimum.

    block      minimum u32, width u8, exceptions u16, positions u8 each, high bits u32 each, packed words u64
    index      block starts u64; document ids i64 and whether they are null u8; document ends (in ids) u64
    trailer    blocks u64, documents u64, ids u64, place of the index u64, mark
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roaskit.llm.bpe import Cuts, Splitter, chunks_of
from roaskit.llm.common import Placed, few_cycles, filesystem, id_and_text, slices, table
from roaskit.sources.storage import materialize, new_folder

BLOCK, SHARE, MARK = 256, 0.9, b"PFORIDS1"
HEAD, TRAILER = struct.Struct("<IBH"), struct.Struct("<QQQQ8s")
#: Blocks decoded at a time, words given to the library at a time, and chunks after which a worker begins a new cache.
READ_BLOCKS, WORDS, CACHE_CHUNKS = 4096, 2000, 700_000
#: Bytes of text that are encoded at a time; their arrays take about 50 bytes for each.
BLOCK_BYTES = 1 << 20


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 numbers below 2**width as rows of 4 * width 64-bit words."""
    lanes = np.ascontiguousarray(values.T, np.uint64)
    out = np.zeros((4 * width, len(values)), np.uint64)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, len(words)), np.uint64)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[i] = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= lanes[word + 1] << np.uint64(64 - shift)
        out[i] &= np.uint64((1 << width) - 1)
    return np.ascontiguousarray(out.T)


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids whose number is a multiple of 256."""
    rows = ids.reshape(-1, BLOCK).astype(np.int64)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    widths = np.sort(bit_lengths(rest), axis=1)[:, int(np.ceil(SHARE * BLOCK)) - 1]
    high = rest >> widths[:, None]
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        of = np.flatnonzero(widths == width)
        packed = pack(rest[of] & ((1 << width) - 1), width)
        for i, words in zip(of.tolist(), packed):
            at = np.flatnonzero(high[i])
            out[i] = b"".join((HEAD.pack(low[i], width, len(at)), at.astype(np.uint8).tobytes(),
                               high[i][at].astype("<u4").tobytes(), words.astype("<u8").tobytes()))
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at `starts` in `data`."""
    out = np.zeros((len(starts), BLOCK), np.int64)
    by_width: dict[int, list[tuple[int, int]]] = {}
    patches = []
    lows = np.zeros(len(starts), np.int64)
    for i, at in enumerate(starts.tolist()):
        lows[i], width, n = HEAD.unpack_from(data, at)
        at += HEAD.size
        if n:
            patches.append((i, width, np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, "<u4", n, at + n)))
        by_width.setdefault(width, []).append((i, at + 5 * n))
    for width, blocks in by_width.items():
        if width:
            words = np.stack([np.frombuffer(data, "<u8", 4 * width, at) for _, at in blocks])
            out[[i for i, _ in blocks]] = unpack(words, width)
    for i, width, at, high in patches:
        out[i, at] |= high.astype(np.int64) << width
    return (out + lows[:, None]).reshape(-1)


class Writer:
    """Appends documents to an open file; holds the ids of one block and a few numbers a document."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.left, self.place = out, np.zeros(0, np.int64), 0
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.ends: list[int] = []
        self.n = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents, the ids of all of them one after another, and how many each has."""
        self.docs += doc_ids
        self.ends += (self.n + np.cumsum(counts)).tolist()
        self.n += len(ids)
        ids = np.concatenate([self.left, ids.astype(np.int64)])
        whole = len(ids) // BLOCK * BLOCK
        self.put(ids[:whole])
        self.left = ids[whole:]

    def put(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), READ_BLOCKS * BLOCK):
            blocks = encode_blocks(ids[at:at + READ_BLOCKS * BLOCK])
            for b in blocks:
                self.starts.append(self.place)
                self.place += len(b)
            self.out.write(b"".join(blocks))

    def close(self) -> None:
        if len(self.left):
            self.put(np.concatenate([self.left, np.full(-len(self.left) % BLOCK, self.left.min())]))
        null = np.array([d is None for d in self.docs], np.uint8)
        self.out.write(b"".join((np.array(self.starts, "<u8").tobytes(), np.array([d or 0 for d in self.docs], "<i8").tobytes(),
                                 null.tobytes(), np.array(self.ends, "<u8").tobytes(),
                                 TRAILER.pack(len(self.starts), len(self.docs), self.n, self.place, MARK))))


def read_documents(path: str, store) -> Iterator[tuple[int | None, np.ndarray]]:
    """Document ids and their token ids, in the order of the file, a run of blocks at a time."""
    with store.open_input_file(path) as f:
        size = f.size()
        blocks, docs, n, place, mark = TRAILER.unpack(f.read_at(TRAILER.size, size - TRAILER.size))
        if mark != MARK:
            raise ValueError(f"{path} is not a file of token ids")
        index = f.read_at(size - TRAILER.size - place, place)
        starts = np.r_[np.frombuffer(index, "<u8", blocks), np.uint64(place)].astype(np.int64)
        doc_ids = np.frombuffer(index, "<i8", docs, 8 * blocks).tolist()
        null = np.frombuffer(index, np.uint8, docs, 8 * (blocks + docs)).tolist()
        ends = np.frombuffer(index, "<u8", docs, 8 * (blocks + docs) + docs).tolist()
        held, base, block = np.zeros(0, np.uint32), 0, 0  # base: the place of held[0] among the file's ids
        for d, is_null, end in zip(doc_ids, null, ends):
            more = [held]
            have = base + len(held)
            while have < end:
                to = min(blocks, block + READ_BLOCKS)
                data = f.read_at(int(starts[to] - starts[block]), int(starts[block]))
                more.append(decode_blocks(data, starts[block:to] - starts[block]).astype("<u4"))
                have, block = have + len(more[-1]), to
            held = np.concatenate(more) if len(more) > 1 else held
            yield (None if is_null else d), held[:end - base]
            held, base = held[end - base:], end


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start:start + size] of each entry, one after another."""
    before = np.cumsum(size) - size
    return values[np.arange(int(size.sum())) + np.repeat(start - before, size)]


class LibraryCoder:
    """Ids of texts by the tokenizers library, which is given each distinct word of a block once.

    The tokenizer's words never span a space, and each ends in a token that only ends words;
    so the ids of a text are those of its words one after another.
    """

    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.special = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.split, self.cuts = Splitter(self.special).split, Cuts(self.special)
        self.age()

    def age(self) -> None:
        """Begins a new cache: of words and of chunks between spaces the number of each, and by number where its ids begin and how many they are."""
        self.known: dict[bytes, int] = {}
        self.words: dict[str, int] = dict(zip(self.special, range(len(self.special))))
        none = np.zeros(0, np.int64)
        self.ids, self.start, self.size = np.zeros(0, np.uint32), none, none
        self.word_ids, self.word_start = np.array(list(self.special.values()), np.uint32), np.arange(len(self.special))
        self.word_size = np.ones(len(self.special), np.int64)

    def learn_words(self, new: list[str]) -> None:
        found, sizes = [self.word_ids], [self.word_size]
        for at in range(0, len(new), WORDS):
            words = new[at:at + WORDS]
            ids = np.array(self.lib.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(words):
                raise ValueError("the vocabulary has no suffix that ends each word")
            found.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.word_ids, self.word_size = np.concatenate(found), np.concatenate(sizes)
        self.word_start = np.cumsum(self.word_size) - self.word_size

    def learn(self, chunks: list[bytes]) -> None:
        """Gives chunks their numbers, and their words' ids one after another."""
        parts = [[s] if (s := c.decode()).isascii() and s.isalpha() and s.islower() else self.split(s) for c in chunks]
        flat = [w for ws in parts for w in ws]
        self.learn_words([w for w in dict.fromkeys(flat) if w not in self.words])
        word = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        ends = np.r_[0, np.cumsum(self.word_size[word])][np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]
        self.known.update(zip(chunks, range(len(self.start), len(self.start) + len(chunks))))
        self.start = np.concatenate([self.start, len(self.ids) + np.r_[0, ends[:-1]][:len(ends)]])
        self.size = np.concatenate([self.size, np.diff(ends, prepend=0)])
        self.ids = np.concatenate([self.ids, ragged(self.word_ids, self.word_start[word], self.word_size[word])])

    def block(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, `end_id` after each, and how many each has.

        Chunks become numbers in Arrow, and only the distinct ones are looked up; the ids are
        put together by one take.
        """
        if len(self.known) > CACHE_CHUNKS:
            self.age()
        chunks, first = chunks_of(texts, self.cuts)
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([c for c in distinct if c not in self.known])
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[chunks.indices.to_numpy()]
        size = self.size[number]
        counts = np.diff(np.r_[0, np.cumsum(size)][first])
        return np.insert(ragged(self.ids, self.start[number], size), np.cumsum(counts), np.uint32(end_id)), counts + 1


_CODERS: dict[str, LibraryCoder] = {}


def coder_of(path: str) -> LibraryCoder:
    """The coder of this worker, which keeps what it has learned from task to task."""
    if path not in _CODERS:
        _CODERS[path] = LibraryCoder(path)
    return _CODERS[path]


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, each followed by `end_id`, in ascending order of the ids of their rows.

    Files are ranges of that order; the table that comes back names them: part, name, n_docs,
    n_tokens. A null text counts as empty, so it has the end id alone; rows without an id come
    first; repeated rows are written again; an empty table gives no files.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        coder, name = coder_of(path), f"ids-{part:06d}.pfor"
        with Placed(folder, name) as out:
            writer = Writer(out)
            for batch in (b for group in ([first], batches) for b in group):
                for piece in slices(batch, most=BLOCK_BYTES):
                    with few_cycles():
                        writer.add(piece.column("_id").to_pylist(), *coder.block(piece.column("_text"), end_id))
            writer.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": len(writer.docs), "n_tokens": writer.n}], schema)

    schema = pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    return materialize(ordered.mapInArrow(task, "part int, name string, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files; with `with_ids` also ids."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for f in batch.to_pylist():
                columns, held, start = tuple([] for _ in schema), 0, f["before"]
                for doc_id, ids in read_documents(f"{root}/{f['name']}", store):
                    row = (doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), ids)
                    for column, x in zip(columns, row):
                        column.append(x)
                    start += len(ids)
                    held += len(ids) if with_ids else 0
                    if len(columns[0]) == 5000 or held > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                        columns, held = tuple([] for _ in schema), 0
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    schema = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "n_tokens", "ids_crc32")] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("part", "name", F.coalesce(before, F.lit(0)).alias("before"))  # a row a file
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return placed.repartition(max(1, files.count())).mapInArrow(task, ddl)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "pfor")
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    return read_token_files(files, folder)
