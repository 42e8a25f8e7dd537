"""Secret scan with structural confirmation.

Three plain patterns give the base spans. Beside them, runs of base64 or hexadecimal text
are decoded and reported only if what they hold parses as a key or a signed token: nested
DER lengths that add up, SSH strings that fill their buffer, a token header that is JSON
and names its algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from roaskit.llm.common import id_and_text, slices, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "key", "ssh", "jwt")

LINES = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/]{48,}\r?\n)*[A-Za-z0-9+/_-]{40,}={0,2}(?:\r?\n[A-Za-z0-9+/]{1,76}={0,2}(?=\r?\n?-----))?")
HEX_LONG = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64,}|[0-9A-F]{64,})(?![0-9A-Za-z])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the items that fill data[start:end]; None if the lengths don't add up."""
    items = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size == 0x80 or tag & 0x1F == 0x1F:
            return None
        if size > 0x80:
            n = size & 0x7F
            if n > 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at:at + n], "big"), at + n
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        start = at + size
    return items


def is_private_der(data: bytes) -> bool:
    """A DER sequence whose items, nested ones too, fill it and read as a PKCS#1, PKCS#8 or EC private key."""
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(data, *outer[0][1:])
    if not items or len(items) < 3 or items[0][0] != 2 or int.from_bytes(data[items[0][1]:items[0][2]], "big") > 1:
        return False
    nested = all(tag & 0x20 == 0 or der_items(data, a, b) is not None for tag, a, b in items)
    tags = [tag for tag, _, _ in items]
    return nested and (len(items) >= 9 and set(tags[:9]) == {2} or tags[1:3] == [0x30, 4] or tags[1] == 4 and set(tags[2:]) <= {0xA0, 0xA1})


def ssh_strings(data: bytes, at: int = 0) -> list[bytes] | None:
    """The length-prefixed strings that fill the buffer."""
    out = []
    while at < len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data) or at + 4 > len(data):
            return None
        out.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return out


OPENSSH = b"openssh-key-v1\x00"


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key file, or a key in SSH's wire form."""
    if data.startswith(OPENSSH):
        at = len(OPENSSH)
        for _ in range(3):                            # cipher, key derivation and its options
            size = int.from_bytes(data[at:at + 4], "big")
            if at + 4 + size > len(data):
                return False
            at += 4 + size
        return len(data) > at + 4 and ssh_strings(data, at + 4) is not None
    if not data[:4] == b"\x00\x00\x00" + data[3:4] or not data[4:8] in (b"ssh-", b"ecds", b"sk-s", b"sk-e"):
        return False
    parts = ssh_strings(data)
    return parts is not None and len(parts) >= 2


def decoded(run: str) -> bytes | None:
    text = re.sub(r"\s+", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_json_object(part: str, needs: str | None = None) -> bool:
    data = decoded(part)
    try:
        said = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(said, dict) and (needs is None or isinstance(said.get(needs), str))


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of what parses as a key or a signed token."""
    for pattern in (LINES, HEX_LONG):
        for m in pattern.finditer(text):
            run = m.group()
            data = (bytes.fromhex(run) if len(run) % 2 == 0 else None) if pattern is HEX_LONG else decoded(run)
            if data:
                if data[0] == 0x30 and is_private_der(data):
                    yield "key", m.start(), m.end()
                elif is_ssh_key(data):
                    yield "ssh", m.start(), m.end()
    if "ey" in text:
        for m in TOKEN.finditer(text):
            if is_json_object(m[1], "alg") and is_json_object(m[2]):
                yield "jwt", m.start(), m.end()


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield "access", m.start(), m.end()
    for m in HEX_RUN.finditer(text):                  # the runs are maximal, so the length may be asked for at once
        yield "hex", m.start(), m.end()


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_confirmed of every row.

    Spans are in code points, ends excluded. A null text counts as empty and has no spans;
    repeated rows and rows without an id are scanned like others; other columns are not read.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("_text").to_pylist():
                    base, more = list(base_spans(text)), list(dict.fromkeys(confirmed(text)))
                    kinds = [k for k, _, _ in base]
                    rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
                yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                        ("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64())])
    return id_and_text(docs, id_col, text_col).mapInArrow(
        task, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
