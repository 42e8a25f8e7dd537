import gzip
import hashlib
import io

import pytest

from roaskit.llm import warc as m
from roaskit.llm.common import filesystem, table
from roaskit.sources.storage import new_folder
from tests.llm.conftest import SMALL


def plain(rows):
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: (r.page_id is None, r.page_id or 0)):
        data = (r.html or "").encode()
        first = seen.setdefault(data, r.page_id) if len(data) >= 100 and r.page_id is not None else seen.get(data)
        again = len(data) >= 100 and first is not None and first != r.page_id
        out.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_round_trip_equals_brute_force(spark):
    long = "<p>" + "déjà " * 300_000
    odd = spark.createDataFrame([(4, "http://é.x/a b?q=1\n", "x" * 100, 1), (3, None, "x" * 100, 2), (None, "u", "x" * 100, None), (9, "u", "y" * 99, 3), (8, "u", "y" * 99, 3),
                                 (7, "u", None, 4), (6, "u", "", 5), (5, "u", long, 6), (10, "u", long, 6), (5, "u", long, 6), (None, None, "z" * 200, 7), (None, None, "z" * 200, 7)],
                                "page_id long, url string, html string, digest int")
    for pages in (table(spark, SMALL, "pages"), odd, odd.limit(0)):
        folder = new_folder(spark, "warc-test")
        rows = m.read_archives(m.write_archives(pages, folder), folder, keep=True).collect()
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
        assert sorted(got, key=repr) == plain(pages.collect())
        assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in rows if r.record_type == "response")


def archive(*payloads):
    return b"".join(m.record(i, "http://x/", p, hashlib.sha256(p).hexdigest(), None, False) for i, p in enumerate(payloads))


class Drip(io.BytesIO):
    def read(self, n=-1):
        return super().read(min(n, 7))


def test_reader_takes_members_in_any_chunks():
    data = archive(b"", b"a\r\n\r\nb" * 1000, b"c" * 500_000)
    assert [(r["payload_bytes"], r["payload"][:6]) for r in m.read_records(Drip(data), keep=True)] == [(0, b""), (6000, b"a\r\n\r\nb"), (500_000, b"cccccc")]
    assert gzip.decompress(data).count(b"WARC/1.0") == 3


def test_reader_refuses_what_is_wrong():
    data = archive(b"payload")
    with pytest.raises(ValueError, match="inside a member"):
        list(m.read_records(io.BytesIO(data[:-3])))
    for old, new, said in ((b"payload", b"pAyload", "block digest"), (b"\r\nContent-Length: ", b"\r\nContent-Length: 9", "framed")):
        with pytest.raises(ValueError, match=said):
            list(m.read_records(io.BytesIO(gzip.compress(gzip.decompress(data).replace(old, new, 1)))))


def test_a_failed_file_leaves_nothing(spark):
    from roaskit.llm.common import Placed
    folder = new_folder(spark, "placed")
    with pytest.raises(ZeroDivisionError):
        with Placed(folder, "a") as out:
            out.write(b"x")
            1 / 0
    store, root = filesystem(folder)
    from pyarrow import fs
    assert not store.get_file_info(fs.FileSelector(root))
