"""BPE encoding and decoding by a pair occurrence index.

A task collects the distinct words of a block of its rows and lays all their symbols out
in one array. An index holds, for each pair with a merge rank, every position at which the
pair stands; the active ranks are applied in ascending order, each at all its positions at
once, and the lists of the pairs that arise are extended. Words are merged once a block
and kept in a bounded cache, so a text costs a lookup a word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from roaskit.llm.common import bytes_of, few_cycles, id_and_text, slices, table, word_runs

#: The word pattern and the white space of the tokenizer's normalizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = r"\t\n\v\f\r \x85\xa0  -     　"
#: Words kept from block to block by a worker, and bytes of text in a block, whose strings and arrays take about 30 bytes for each.
CACHE_WORDS, BLOCK_BYTES = 120_000, 1 << 20
#: Which bytes part chunks.
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True

_LATIN = regex.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_WORDS = regex.compile(WORD_PATTERN.replace(r"[^\s", f"[^{WHITE}"))


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in own)
    stand = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [stand[b] for b in range(256)]


class Splitter:
    """Cuts texts into words as the tokenizer's normalizer and pre-tokenizer do; none spans a space or line feed."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.opens = min(special, key=len)[0] if special else None

    def pieces(self, chunk: str) -> list[str]:
        """The words of a text that holds no special token, normalized."""
        text = unicodedata.normalize("NFC", chunk)
        return _WORDS.findall("".join(c.lower() for c in text))

    def split(self, chunk: str) -> list[str]:
        """Words and special tokens of a text without spaces and line feeds."""
        letters = chunk.rstrip(".,")
        if letters.isalpha() and (letters.isascii() or _LATIN.fullmatch(letters)):
            return [letters.lower(), chunk[len(letters):]] if len(letters) < len(chunk) else [letters.lower()]
        if self.special and self.opens in chunk:
            parts = self.at_special.split(chunk)
            return [w for p in parts if p for w in ([p] if p in self.special else self.pieces(p))]
        return self.pieces(chunk)


class Vocabulary:
    """Merge ranks and token texts of a byte-level BPE file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        self.suffix, self.special = suffix, {x["content"]: x["id"] for x in said["added_tokens"]}
        self.texts = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[m[side]] for m in merges], np.int64) for side in (0, 1))
        self.merged = np.array([ids["".join(m)] for m in merges], np.int64)
        self.left, self.right = left, right
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int64)
        self.last = np.array([ids[x + suffix] for x in letters], np.int64)
        self.split = Splitter(self.special).split

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_words(v: Vocabulary, words: list[str]) -> tuple[list[int], list[int]]:
    """The token ids of the words, none of them empty, one after another, and the number of each word's ids.

    This is the pair occurrence index: `places` has the positions of every pair by its rank.
    """
    if not words:
        return [], []
    coded = [w.encode("utf-8") for w in words]
    sizes = np.array([len(c) for c in coded], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(coded), np.uint8)
    n = len(raw)
    sym = np.empty(n + 1, np.int64)
    sym[:n] = v.inner[raw]
    sym[ends - 1] = v.last[raw[ends - 1]]
    sym[n] = -2                                       # the symbol beyond every word
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1] = n
    before[ends[:-1]] = -1

    ranks = v.rank(sym[:n], sym[after[:n]])
    at = np.flatnonzero(ranks >= 0)
    at = at[np.argsort(ranks[at], kind="stable")]
    found, first = np.unique(ranks[at], return_index=True)
    places: dict[int, list[np.ndarray]] = {r: [p] for r, p in zip(found.tolist(), np.split(at, first[1:]))}
    active = found.tolist()                           # ascending, so a heap already
    odd: set[int] = set()
    while active:
        r = heapq.heappop(active)
        listed = places.pop(r)
        pos = listed[0] if len(listed) == 1 else np.unique(np.concatenate(listed))
        left, right = v.left[r], v.right[r]
        pos = pos[(sym[pos] == left) & (sym[after[pos]] == right)]
        if not len(pos):
            continue
        if left == right:                             # of overlapping pairs the leftmost is taken
            taken, free = [], -1
            for p in pos.tolist():
                if p != free:
                    taken.append(p)
                    free = after[p]
            pos = np.array(taken, np.int64)
        gone = after[pos]
        sym[pos], sym[gone] = v.merged[r], -1
        beyond = after[gone]
        after[pos] = beyond
        inside = beyond < n
        before[beyond[inside]] = pos[inside]
        ahead = before[pos]
        news = np.concatenate([ahead[ahead >= 0], pos[inside]])
        rank = v.rank(sym[news], sym[after[news]])
        some = rank >= 0
        news, rank = news[some], rank[some]
        if (low := rank < r).any():                   # merged out of its word's order: done again below
            odd.update(np.searchsorted(ends, news[low], "right").tolist())
        if len(news) > 64:
            order = np.argsort(rank, kind="stable")
            news, rank = news[order], rank[order]
            kinds, first = np.unique(rank, return_index=True)
            groups = zip(kinds.tolist(), np.split(news, first[1:]))
        else:
            by: dict[int, list[int]] = {}
            for k, p in zip(rank.tolist(), news.tolist()):
                by.setdefault(k, []).append(p)
            groups = ((k, np.array(p, np.int64)) for k, p in by.items())
        for k, p in groups:
            if k in places:
                places[k].append(p)
            else:
                places[k] = [p]
                heapq.heappush(active, k)
    live = sym[:n] >= 0
    counts = np.add.reduceat(live, np.r_[0, ends[:-1]], dtype=np.int64)
    ids = sym[:n][live]
    if odd:
        each = np.split(ids, np.cumsum(counts)[:-1])
        for i in odd:
            each[i] = one_word(v, coded[i])
        ids, counts = np.concatenate(each), np.array([len(x) for x in each])
    return ids.tolist(), counts.tolist()


def one_word(v: Vocabulary, coded: bytes) -> np.ndarray:
    """A single word, always merging the lowest rank, leftmost first."""
    raw = np.frombuffer(coded, np.uint8)
    sym = v.inner[raw]
    sym[-1] = v.last[raw[-1]]
    while len(sym) > 1:
        ranks = v.rank(sym[:-1], sym[1:])
        if ranks.max() < 0:
            break
        i = int(np.where(ranks < 0, len(v.merged), ranks).argmin())
        sym = np.r_[sym[:i], v.merged[ranks[i]], sym[i + 2:]]
    return sym


_LOADED: dict[str, tuple[Vocabulary, dict]] = {}


def loaded(path: str) -> tuple[Vocabulary, dict]:
    """The vocabulary and the word cache of this worker."""
    if path not in _LOADED:
        _LOADED[path] = (Vocabulary(path), {})
    return _LOADED[path]


class Cuts:
    """Where chunks may be cut further, and which letters made small, before the distinct ones are looked for.

    A word ends between an ASCII letter and a mark or digit of ASCII, and beside every such digit,
    whatever stands around; the apostrophe, which begins words like 's, and the marks and digits
    of special tokens are left out.
    """

    def __init__(self, special: dict[str, int]):
        self.special = [s.encode() for s in special]
        kept = set(b"'").union(*self.special)
        self.kind = np.zeros(256, np.uint8)           # 1: a letter, 2: a mark, 3: a digit; 0: neither
        for b in range(33, 127):
            c = chr(b)
            self.kind[b] = 1 if c.isalpha() else 0 if b in kept else 3 if c.isdigit() else 2

    def small(self, raw: np.ndarray) -> np.ndarray:
        """Capitals of ASCII as small letters, but those before a byte that is not ASCII (an accent may join them), and none if a special token would arise."""
        capital = (raw >= 65) & (raw <= 90)
        capital[:-1] &= raw[1:] < 128
        lower = raw + (capital.view(np.uint8) << 5)
        same = all(s == s.lower() and raw.tobytes().count(s) == lower.tobytes().count(s) for s in self.special)
        return lower if same else raw

    def beginnings(self, raw: np.ndarray) -> np.ndarray:
        """At which bytes a word begins right where the one before ends."""
        kind, out = self.kind[raw], np.zeros(len(raw), bool)
        a, b = kind[:-1], kind[1:]
        out[1:] = (a > 0) & (b > 0) & ((a != b) | (a == 3))
        return out


def chunks_of(texts: pa.Array, cuts: Cuts | None = None) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The stretches without spaces and line feeds of all texts, as numbers of the distinct ones in UTF-8, and the first of each text (one more than texts).

    No word of the tokenizer spans two of them. With `cuts` they are cut further, and stand for
    the same words.
    """
    raw, offsets = bytes_of(texts)
    inside = ~_BREAK[raw]
    starts, ends, first = word_runs(inside, offsets)
    if cuts is not None and len(raw):
        begins, stops = cuts.beginnings(raw), np.zeros(len(raw) + 1, bool)
        stops[:-1] = begins
        begins[starts], stops[ends] = True, True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
        raw, first = cuts.small(raw), np.searchsorted(starts, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[inside])])
    return plain.dictionary_encode(), first


class Coder:
    """Texts to ids and back, keeping (ids as text, tokens as text, number of ids) for each word."""

    def __init__(self, path: str):
        self.v, self.words = loaded(path)

    def block(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, the ids joined by spaces, and the decoded text.

        Only the distinct chunks of the block are strings here; the texts hold their numbers.
        """
        chunks, first = chunks_of(texts)
        parts = [self.v.split(c.decode()) for c in chunks.dictionary.to_numpy(zero_copy_only=False).tolist()]
        self.learn(set().union(*parts))
        words, ids, tokens = self.words, [], []
        counts = np.zeros(len(parts), np.int64)
        for i, ws in enumerate(parts):
            got = [words[w] for w in ws]
            ids.append(got[0][0] if len(got) == 1 else " ".join([g[0] for g in got]))
            tokens.append(got[0][1] if len(got) == 1 else " ".join([g[1] for g in got]))
            counts[i] = sum([g[2] for g in got])
        del parts
        number = chunks.indices.to_numpy()
        some = counts[number] > 0
        first, number = np.r_[0, np.cumsum(some)][first].tolist(), number[some]
        total = np.r_[0, np.cumsum(counts[number])]
        for a, b in zip(first, first[1:]):
            of = number[a:b].tolist()
            yield int(total[b] - total[a]), " ".join([ids[i] for i in of]), " ".join([tokens[i] for i in of])
        if len(self.words) > CACHE_WORDS:
            self.words.clear()

    def learn(self, words: set[str]) -> None:
        """Puts the words that the cache lacks there."""
        v, known = self.v, self.words
        known.update((w, (str(i), w, 1)) for w, i in v.special.items())
        new = list(words.difference(known))
        ids, counts = merge_words(v, new)
        numbers, texts, at = [str(i) for i in ids], [v.texts[i] for i in ids], 0
        for w, n in zip(new, counts):
            known[w] = (numbers[at], texts[at], 1) if n == 1 else (" ".join(numbers[at:at + n]), " ".join(texts[at:at + n]), n)
            at += n


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; with `full` also ids and decoded.

    `path` is a vocabulary file that every executor has. A null or empty text, or one of
    white space, has no ids and decodes to the empty text. Rows stay as they are, repeated
    ones and those without an id too; an empty table gives no rows; other columns are not read.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            for part in slices(batch, most=BLOCK_BYTES):
                cols: dict[str, list] = {k: [] for k in schema.names[1:]}
                with few_cycles():
                    for n, ids, text in coder.block(part.column("_text")):
                        cols["n_tokens"].append(n)
                        cols["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                        cols["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                        if full:
                            cols["ids"].append([int(i) for i in ids.split()])
                            cols["decoded"].append(text)
                yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(cols[k], schema.field(k).type) for k in cols)], schema=schema)

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if full:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        ddl += ", ids array<int>, decoded string"
    schema = pa.schema(fields)
    return id_and_text(docs, id_col, text_col).mapInArrow(task, ddl)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
