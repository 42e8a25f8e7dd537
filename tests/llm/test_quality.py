import zlib

import numpy as np
import pyarrow as pa
import pytest

from roaskit.llm import quality as m
from roaskit.llm.common import table


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def parts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs, labels, m.fitted(docs, labels)


def test_held_out_accuracy(parts):
    docs, labels, model = parts
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = m.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in quality]
    good = [r.predicted for r in test if quality[r.doc_id]]
    bad = [r.predicted for r in test if not quality[r.doc_id]]
    assert len(test) > 50 and np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_labels_of_held_out_rows_and_other_columns_don_t_matter(spark, parts):
    docs, labels, model = parts
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    assert m.fitted(docs.selectExpr("doc_id", "text", "'x' as lang", "1 as quality", "0 as score").repartition(5), other.union(other)) == model


def test_odd_rows(spark, parts, odd_documents):
    rows = m.scored(odd_documents.selectExpr("*", "0 as score", "1 as _label"), parts[2]).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1 and len({r.score for r in rows if r.doc_id == 2}) == 1
    assert m.scored(odd_documents.limit(0), parts[2]).count() == 0
    assert m.fitted(odd_documents, parts[1].limit(0)) == b""                      # nothing to learn: a defined score for all, see test_filters


def test_pooling_of_a_text_doesn_t_depend_on_its_neighbours():
    texts = ["one two two THREE.", "", "a", "Aich Aich Aich!! x"]
    index = m.index_vectors()
    vectors = m.word_vectors(iter([m.terms_of(pa.array(texts))])).astype(np.float32)
    together = m.pooled(vectors, index, *m.terms_of(pa.array(texts)))
    for i, t in enumerate(texts):
        np.testing.assert_allclose(m.pooled(vectors, index, *m.terms_of(pa.array([t])))[0], together[i], atol=1e-5)


def test_word_vectors_are_sums_around():
    words, shapes, first = m.terms_of(pa.array(["u v w", "x"]))
    index, got = m.index_vectors(), m.word_vectors(iter([(words, shapes, first)]))
    for at, around in ((0, [1, 2]), (1, [0, 2]), (2, [1, 0])):
        want = index[words[around]].sum(axis=0)
        np.testing.assert_allclose(got[words[at]], want / np.linalg.norm(want), atol=1e-5)
