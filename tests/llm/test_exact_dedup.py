import hashlib
import re
from collections import defaultdict

from roaskit.llm import exact_dedup as m


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", r.text or "").encode()).digest()].append(r.doc_id)
    out = []
    for digest, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=repr)


def test_groups_equal_brute_force(spark, documents, odd_documents):
    for docs in (documents, odd_documents, documents.limit(0)):
        for counters in (1, 3, 256):
            got = [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in m.exact_groups(docs, counters=counters).collect()]
            assert sorted(got, key=repr) == plain(docs.collect())


def test_summaries_name_every_frequent_digest(spark):
    rows = [(bytes([i % 40]),) for i in range(2000)] + [(b"x",)] * 700 + [(b"y",)] * 400
    digests = spark.createDataFrame(rows, "digest binary").repartition(7)
    found = {bytes(r.digest) for r in m.frequent_candidates(digests, 8).collect()}
    assert {b"x", b"y"} <= found and len(found) <= 8


def test_filter_keeps_columns_and_rows_without_id(spark, odd_documents):
    left = m.deduplicated(odd_documents)
    assert left.columns == odd_documents.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([1, 3, 5, 6, 7, None, None], key=repr)
