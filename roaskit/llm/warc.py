"""WARC archives: a gzip member a record, payloads equal to an earlier page's written as revisits, and a sequential reader.

The reader holds one chunk of the archive and, unless payloads are asked for, no record:
it inflates step by step, frames the block by its length, and takes both digests on the way.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roaskit.llm.common import Placed, filesystem, table
from roaskit.sources.storage import materialize, new_folder

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 100
CHUNK, LEVEL, DATE = 1 << 18, 3, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    text = record.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + END + block + END) + deflate.flush()


def headers_of(data: bytes) -> dict[str, str]:
    lines = data.decode().split("\r\n")
    return {"": lines[0]} | {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Record:
    """A record that is being read: bytes go in as they are inflated."""

    def __init__(self, keep: bool):
        self.keep, self.head, self.http = keep, bytearray(), bytearray()
        self.fields: dict[str, str] | None = None
        self.http_fields: dict[str, str] | None = None
        self.left, self.tail = 0, b""
        self.block, self.payload, self.size, self.kept = hashlib.sha256(), hashlib.sha256(), 0, []

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            at = self.head.find(END)
            if at < 0:
                return
            self.fields, data = headers_of(bytes(self.head[:at])), bytes(self.head[at + 4:])
            self.left, self.head = int(self.fields["content-length"]), bytearray()
        mine, data = data[:self.left], data[self.left:]
        self.left -= len(mine)
        self.tail += data
        self.block.update(mine)
        if self.http_fields is None:
            self.http += mine
            at = self.http.find(END)
            if at < 0:
                return
            self.http_fields, mine = headers_of(bytes(self.http[:at])), bytes(self.http[at + 4:])
            self.http = bytearray()
        self.payload.update(mine)
        self.size += len(mine)
        if self.keep:
            self.kept.append(mine)

    def done(self) -> dict:
        """The record's row; an error if its framing or a digest is wrong."""
        if self.fields is None or self.http_fields is None or self.left or self.tail != END or not self.fields[""].startswith("WARC/"):
            raise ValueError("a record that is cut or badly framed")
        f, kind = self.fields, self.fields["warc-type"]
        size, digest = int(self.http_fields["content-length"]), f["warc-payload-digest"].removeprefix("sha256:")
        if f["warc-block-digest"] != f"sha256:{self.block.hexdigest()}":
            raise ValueError(f"block digest of {f['warc-record-id']}")
        if kind == "response" and (digest, size) != (self.payload.hexdigest(), self.size):
            raise ValueError(f"payload digest of {f['warc-record-id']}")
        row = {"page_id": page_of(f["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
               "refers_to": page_of(f["warc-refers-to"]) if kind == "revisit" else None, "target_uri": f.get("warc-target-uri")}
        return row | ({"payload": b"".join(self.kept) if kind == "response" else None} if self.keep else {})


def read_records(stream, keep: bool = False) -> Iterator[dict]:
    """The records of an archive, one gzip member after another."""
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        inflate, rec = zlib.decompressobj(31), Record(keep)
        while not inflate.eof:
            rec.feed(inflate.decompress(rest, CHUNK))
            rest = inflate.unconsumed_tail or inflate.unused_data
            if not inflate.eof and not rest and not (rest := stream.read(CHUNK)):
                raise ValueError("an archive that ends inside a member")
        yield rec.done()


def record_plan(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """page_id and digest of each page that is to be a revisit, and the page it refers to.

    The digests are written once; hot payloads are reduced by partial sums before the
    shuffle, and the join back has narrow rows and one row a payload on its other side.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    sums = materialize(pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"),
                                    F.octet_length(payload).alias("bytes")).filter(F.col("bytes") >= LEAST_BYTES).drop("bytes"), "payload-digests")
    first = sums.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return sums.join(first, "digest").filter("not page_id <=> refers_to").select(
        F.coalesce("page_id", F.lit(-1)).alias("_page"), F.col("page_id").isNull().alias("_no_page"), F.col("digest").alias("_digest"), "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for every row, an archive a task, and returns the archives: name and records.

    Of equal payloads of 100 bytes or more the smallest id is the response and the others
    revisit it; a row that repeats the response, id included, is a response too. A null payload
    counts as empty; a row without an id is a revisit if an equal payload has one, else a
    response; without a url there is no target. An empty table gives no archives.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.cast("binary").alias("payload"),
                        F.sha2(payload, 256).alias("digest"))
    same = ((F.coalesce("page_id", F.lit(-1)) == F.col("_page")) & (F.col("page_id").isNull() == F.col("_no_page")) & (F.col("digest") == F.col("_digest")))
    rows = rows.join(record_plan(pages, id_col, payload_col), same, "left").select(
        "page_id", "url", "payload", "digest", "refers_to", F.col("_page").isNotNull().alias("revisit"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, n = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with Placed(folder, name) as out:
            for batch in (b for group in ([first], batches) for b in group):
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit"))):
                    out.write(record(*(x.as_py() for x in row)))
                n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [n]})

    return materialize(rows.mapInArrow(task, "name string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str, keep: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and target_uri of every record; with `keep` the payload of responses.

    A record whose framing or digests are wrong ends the job.
    """
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
              ("refers_to", pa.int64()), ("target_uri", pa.string())] + ([("payload", pa.binary())] if keep else [])
    schema = pa.schema(fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows: list[dict] = []
                with store.open_input_file(f"{root}/{name}") as f:
                    for row in read_records(f, keep):
                        rows.append(row)
                        if len(rows) == (20 if keep else 2000):
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string" + (", payload binary" if keep else "")
    return archives.select("name").repartition(max(1, archives.count())).mapInArrow(task, ddl)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder).drop("target_uri")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest,
                  min(page_id) OVER (PARTITION BY sha256(html)) AS first_page FROM p),
     r AS (SELECT *, payload_bytes >= 100 AND page_id <> first_page AS again FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_page END AS refers_to
FROM r
"""
