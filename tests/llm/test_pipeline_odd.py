"""The pipeline over nulls, empty and long texts, repeated rows, shared ids and clashing names, and over empty tables."""

import corpus_pipeline

LONG = " ".join(f"word{i}" for i in range(30_000))


def run(spark, tmp_path, docs, labels, items):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_pipeline_over_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, "the same text of a few words", 1), (2, "the same  text of a few words", 2), (2, "another text of the same id", 3), (None, None, None), (3, None, 4),
            (4, "", 5), (5, LONG, 6), (6, LONG + " more", 7), (7, "one\x0btext", 8), (7, "one\x0btext", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _dropped int")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three four five six"), (None, None)], "item_id long, text string")
    got = run(spark, tmp_path, docs, labels, items)
    assert sorted(str(r.doc_id) for r in got) == sorted(["1", "2", "3", "5", "7", "7", "None"])
    assert run(spark, tmp_path, docs.limit(0), labels.limit(0), items.limit(0)) == []
