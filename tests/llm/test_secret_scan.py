import base64
import hashlib
import json
import re

import pytest

from roaskit.llm import secret_scan as m


def plain(text):
    """The three patterns, match by match."""
    found = []
    for m_ in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m_.group(2)) >= 12:
            found.append(("assign", *m_.span()))
    found += [("access", *x.span()) for x in re.finditer("AKIA[A-Z0-9]+", text) if len(x.group()) >= 18]
    found += [("hex", *x.span()) for x in re.finditer("[0-9a-f]+", text) if len(x.group()) >= 16]
    return found


def test_base_spans_equal_brute_force(spark, documents, odd_documents):
    for docs in (documents, odd_documents, documents.limit(0)):
        want = []
        for r in docs.collect():
            s = sorted(plain(r.text or ""), key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
            said = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
            want.append((r.doc_id or -1, *(sum(k == x[0] for x in s) for k in ("assign", "access", "hex")), hashlib.sha256(said.encode()).hexdigest()))
        got = [(r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in m.scanned(docs).collect()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("text, n", [("token=abc token:secret:abcdefghijklmnop", 0), ("API_KEY = 'abcdefghijkl'", 1), ("éé Password: \"abcdefghijk\"", 0),
                                     ("apikey=token=abcdefghijkl", 1), ("toKen=abcdefghijklmnop", 0), ("AKIA" + "A" * 14, 1), ("0123456789abcde", 0), ("0123456789abcdef", 1)])
def test_base_cases(text, n):
    assert len(list(m.base_spans(text))) == n and sorted(m.base_spans(text)) == sorted(plain(text))


def der(tag, data):
    n = len(data)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + data


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([i + 1]) * 40) for i in range(8)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, RSA))
EC = der(0x30, der(2, b"\1") + der(4, b"k" * 32) + der(0xA0, der(6, b"\x2a\x86\x48\xce")))
WIRE = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-rsa", b"\1\0\1", b"n" * 64))
OPEN = m.OPENSSH + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + b"".join(len(x).to_bytes(4, "big") + x for x in (WIRE, b"p" * 80))


def b64(data):
    return base64.b64encode(data).decode()


def url64(said):
    return base64.urlsafe_b64encode(json.dumps(said).encode()).decode().rstrip("=")


@pytest.mark.parametrize("data, kind", [(RSA, "key"), (PKCS8, "key"), (EC, "key"), (WIRE, "ssh"), (OPEN, "ssh")])
def test_keys_are_confirmed_by_their_structure(data, kind):
    for run in (b64(data), data.hex(), data.hex().upper(), base64.urlsafe_b64encode(data).decode()):
        text = f"é see {run} here"
        assert ((kind, 6, 6 + len(run)) in set(m.confirmed(text)))
    for wrong in (data[:-1], data + b"\0", b"\x31" + data[1:]):
        assert not [x for x in m.confirmed(b64(wrong)) if x[0] == kind]


def test_a_key_over_several_lines():
    body = "\n".join(b64(RSA)[i:i + 64] for i in range(0, len(b64(RSA)), 64))
    text = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    (kind, a, b), = m.confirmed(text)
    assert kind == "key" and text[a:b] == body


def test_signed_tokens():
    good = f"{url64({'alg': 'HS256', 'typ': 'JWT'})}.{url64({'sub': 1})}.c2lnbmF0dXJl"
    assert list(m.confirmed(f"x {good}.")) == [("jwt", 2, 2 + len(good))]
    for bad in (f"{url64({'typ': 'JWT'})}.{url64({'sub': 1})}.c2ln", f"{url64({'alg': 'none'})}.{url64([1])}.c2ln", "eyAAAAAAAAAAAA.BBBB.CCC"):
        assert not list(m.confirmed(bad))


def test_spans_list_all_kinds_in_order(spark):
    text = f"token={'a' * 12} AKIA{'B' * 14} {RSA.hex()}"
    row = m.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert re.sub(r":\d+:\d+", "", row.spans) == "assign,access,hex,key" and row.n_confirmed == 1
