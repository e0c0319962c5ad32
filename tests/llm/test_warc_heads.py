"""Without payloads, HTTP headers are read to their end."""

import random

import pyarrow as pa

from larkspur.llm import warc


def test_long_http_headers_without_payload():
    """HTTP headers that go on past the first read of a member are read to their end; a payload isn't."""
    rng = random.Random(1)
    noise = lambda n: bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz0123456789", k=n)).decode()
    http = f"HTTP/1.1 200 OK\r\nX-Long: {noise(9000)}\r\nContent-Length: 7\r\n\r\n".encode()
    target = f"http://a/{noise(6200)}"  # so that the first read ends inside the HTTP header of some records
    records = [warc.record("urn:page:1", "revisit", "2024-01-01T00:00:00Z", target[:n], "0", 7, None, "urn:page:0") for n in range(5200, 6200, 10)]
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:2>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n"
    records += [head % len(http + body) + http + body + b"\r\n\r\n" for body in (b"payload", noise(50_000).encode())]
    records.append(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 20000\r\n\r\n" + noise(20_000).encode() + b"\r\n\r\n")
    data = b"".join(warc.member(r) for r in records)
    rows = list(warc.read_records(pa.BufferReader(data), "x", warc.Wanted({}, {}, False)))
    assert len(rows) == len(records)
    names = warc.SCHEMA.names
    assert [dict(r[names.index("http_headers")]).get("content-length") for r in rows] == ["7"] * (len(records) - 1) + [None]
