import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from roaskit.llm import bpe, token_files
from roaskit.llm.common import slices
from roaskit.sources.storage import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encoding_and_decoding_equal_the_library(spark, documents, odd_documents, library):
    for docs in (documents, odd_documents):
        want = []
        for r in docs.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id or -1, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(docs, PATH).collect()]
        assert sorted(got) == sorted(want)


def test_words_that_repeat_a_pair(library):
    words = ["aaaaaaa", "hahahahahaha", "ththththth", "ininininin", "zzzzzzzzzzz", "q", "eeee", "ééééé", "你好你好", "!!!!!!!"]
    ids, counts = bpe.merge_words(bpe.Vocabulary(PATH), words)
    ends = np.cumsum(counts)
    for w, a, b in zip(words, ends - counts, ends):
        assert ids[a:b] == library.encode(w, add_special_tokens=False).ids
        assert bpe.one_word(bpe.Vocabulary(PATH), w.encode()).tolist() == ids[a:b]


def test_full_output_has_ids_and_text(spark, odd_documents, library):
    row = bpe.encoded(odd_documents.filter("doc_id = 7"), PATH, full=True).first()
    assert library.decode(row.ids, skip_special_tokens=False) == row.decoded and len(row.ids) == row.n_tokens


def test_blocks_keep_any_ids():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(256, int), np.arange(512), rng.integers(0, 2**32 - 1, 1024), np.r_[rng.integers(0, 50, 250), [2**32 - 1] * 6]):
        blocks = token_files.encode_blocks(ids)
        starts = np.cumsum([0] + [len(b) for b in blocks])[:-1]
        assert (token_files.decode_blocks(b"".join(blocks), starts) == ids).all()


def test_outliers_become_exceptions():
    ids = np.full(256, 7)
    ids[::50] = 40_000
    assert len(token_files.encode_blocks(ids)[0]) == token_files.HEAD.size + 5 * 6


def test_files_hold_the_library_s_ids_in_order(spark, documents, odd_documents, library):
    for docs in (documents, odd_documents, documents.limit(0)):
        folder = new_folder(spark, "pfor-test")
        rows = token_files.read_token_files(token_files.write_token_files(docs, PATH, 2, folder), folder, with_ids=True).collect()
        want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
        at = 0
        assert len(rows) == len(want)
        for (has, d, text), r in zip(want, sorted(rows, key=lambda r: r.start)):
            ids = library.encode(text, add_special_tokens=False).ids + [2]
            assert (r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids) == (has, d, at, len(ids), ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4"))
            at += len(ids)


def test_marks_digits_and_capitals_make_no_new_chunks(library):
    coder = token_files.LibraryCoder(PATH)
    texts = ["Word word, WORD. (word) word-word 7word72", "don't DON'T 'sword's. <|endoftext|>word. <|ENDOFTEXT|>", None,
             "Ét H̱a. ≠x ½7, aéB.c中9", "<|startoftext|>"]
    ids, counts = coder.block(pa.array(texts), 2)
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == library.encode(text or "", add_special_tokens=False).ids + [2]
    coder = token_files.LibraryCoder(PATH)
    coder.block(pa.array(texts[:1]), 2)
    assert set(coder.known) == {b"word", b",", b".", b"(", b")", b"-", b"7", b"2"}


def test_a_block_takes_little_memory():
    rng = np.random.default_rng(1)
    letters = rng.integers(97, 123, (500_000, 7), np.uint8)
    letters[:, 6] = 32
    texts = [bytes(x.tobytes()).decode() for x in np.array_split(letters, 100)]
    batch = pa.RecordBatch.from_pydict({"_text": texts})
    coder = bpe.Coder(PATH)
    part = next(slices(batch, most=bpe.BLOCK_BYTES))
    tracemalloc.start()
    for _ in coder.block(part.column(0)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
