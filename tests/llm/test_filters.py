"""The pipeline's filters on rows that share ids, clashing names, nulls, repeated rows and empty tables."""

import pytest

from roaskit.llm import decontaminate, exact_dedup, near_dedup, quality

LONG = " ".join(f"word{i}" for i in range(60))
ITEM = " ".join(f"question{i}" for i in range(30))
DDL = "doc_id long, text string, _dropped int, _gone_id string, kept int, _key int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DDL)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_a_row_goes_for_its_own_text(spark):
    docs = table(spark, [(5, "alpha beta"), (5, "other text"), (3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (6, None), (4, "")])
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert left(got) == sorted([(5, "other text"), (3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (4, "")], key=repr)
    leaky = table(spark, [(5, f"see {ITEM} end"), (5, "other text"), (None, ITEM), (7, None), (8, "")])
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, ITEM.upper()), (None, None), (3, "")], "item_id long, text string")
    got = decontaminate.decontaminated(leaky, items)
    assert got.columns == leaky.columns
    assert left(got) == sorted([(5, "other text"), (None, ITEM), (7, None), (8, "")], key=repr)


def test_near_copies_with_clashing_names(spark):
    docs = table(spark, [(2, LONG), (1, LONG + " more"), (9, "quite another text"), (None, LONG), (4, None)])
    got = near_dedup.without_near_copies(docs)
    assert got.columns == docs.columns
    assert left(got) == sorted([(1, LONG + " more"), (9, "quite another text"), (None, LONG), (4, None)], key=repr)


def test_rejected_rows_of_a_shared_id(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fitted(documents, labels)
    by = {r.predicted: r for r in quality.scored(documents, model).filter("doc_id is not null").collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    good, bad = texts[by[1].doc_id], texts[by[0].doc_id]
    docs = table(spark, [(10**6, good), (10**6, bad), (None, bad)]).unionByName(documents.select("doc_id", "text"), allowMissingColumns=True)
    got = quality.accepted(docs, labels)
    assert got.columns == docs.columns
    kept = left(got.filter("doc_id = 1000000 or doc_id is null"))
    assert (10**6, good) in kept and (10**6, bad) not in kept and (None, bad) in kept


@pytest.mark.parametrize("empty", ["documents", "labels", "both"])
def test_quality_without_documents_or_labels(spark, documents, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = documents.limit(0) if empty != "labels" else documents
    labels = labels.limit(0) if empty != "documents" else labels
    scores = quality.scored(docs, quality.fitted(docs, labels))
    assert scores.count() == docs.count() and scores.filter(f"score <> {quality.UNKNOWN}").count() == 0
    assert quality.accepted(docs, labels).count() == docs.count()


def test_equal_benchmark_items_stay_in_one_block(spark):
    items = spark.createDataFrame([(i % 3, ITEM) for i in range(50)] + [(9, LONG)], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM), (2, LONG), (3, "nothing")], "doc_id long, text string")
    got = decontaminate.leaks(docs, items, block_words=20)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted([(1, i % 3) for i in range(50)] + [(2, 9)])
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
