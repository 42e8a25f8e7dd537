import re

import corpus_pipeline
from roaskit.llm import bpe, quality
from roaskit.llm.common import table
from tests.llm.conftest import SMALL
from tests.llm.test_exact_dedup import plain as exact_groups
from tests.llm.test_near_dedup import plain as near_groups


def test_stages_equal_brute_force(spark, documents):
    docs, labels = documents, table(spark, SMALL, "labels")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        if name != "bpe":
            assert docs.columns == documents.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        left.append({r.doc_id for r in docs.collect()})
    rows = documents.collect()
    scores = {r.doc_id: r.predicted for r in quality.scored(documents, quality.fitted(documents, labels)).collect()}
    kept = [r for r in rows if scores[r.doc_id]]
    assert left[0] == {r.doc_id for r in kept} and 0 < len(kept) < len(rows)
    first = {g[0] for g in exact_groups(kept) if g[3]}
    assert left[1] == first and len(first) < len(kept)
    kept = [r for r in kept if r.doc_id in first]
    first = {g[0] for g in near_groups(kept) if g[3]}
    assert left[2] == first
    words = lambda s: " " + " ".join(re.findall(r"\w+", s.lower())) + " "
    items = [words(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    whole = {r.doc_id for r in kept if any(i in words(r.text) for i in items)}
    assert left[3] == left[2] - whole
    assert left[4] == left[3]


def test_run_gives_the_rows_of_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == bpe.encoded(table(spark, SMALL, "documents").limit(0), "").columns and got.count() > 50
