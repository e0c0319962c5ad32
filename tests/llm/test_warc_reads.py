"""Records whose heads outgrow one read, and how much of an archive is read when no payload is wanted."""

import io
import random

import pytest
from pyspark.sql import functions as F

from larkspur.llm import warc

DATE, DIGEST = "2024-01-01T00:00:00Z", "sha256:" + "0" * 64


class Counted(io.BytesIO):
    """A file that counts the bytes it is asked for."""

    def __init__(self, data):
        super().__init__(data)
        self.taken, self.length = 0, len(data)

    def size(self):
        return self.length

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def noise(n):
    """Letters that hardly compress."""
    rng = random.Random(n)
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))


@pytest.mark.parametrize("packed", [False, True])
def test_heads_of_any_length_tell_the_size(packed):
    """Targets with lengths around the multiples of what one read takes, where a read may end inside either head."""
    near = [k * warc.HEAD_BYTES + d for k in (1, 2, 3) for d in range(-420, 12, 9)]
    sizes = [0, 1, 100, 4998, 10_400, *near]
    records = [warc.record(f"urn:page:{i}", "revisit", DATE, f"http://h/{noise(n)}", DIGEST, 1000 + i, None, "urn:page:0") for i, n in enumerate(sizes)]
    data = b"".join(warc.member(r) if packed else r for r in records)
    rows = list(warc.read_records(Counted(data), "a", warc.Wanted({}, {}, False)))
    assert [dict(r[6]).get("content-length") for r in rows] == [str(1000 + i) for i in range(len(sizes))]
    assert [len(r[2]) for r in rows] == [len("http://h/") + n for n in sizes]


@pytest.mark.parametrize("packed", [False, True])
def test_unwanted_payloads_are_not_read(packed):
    payload = noise(3_000_000).encode()
    records = [warc.record(f"urn:page:{i}", "response", DATE, "http://h/", DIGEST, len(payload), payload, None) for i in range(3)]
    data = b"".join(warc.member(r) if packed else r for r in records)
    stream = Counted(data)
    rows = list(warc.read_records(stream, "a", warc.Wanted({}, {}, False)))
    assert [dict(r[6])["content-length"] for r in rows] == ["3000000"] * 3 and stream.taken < 40_000
    stream = Counted(data)
    (row,) = warc.read_records(stream, "a", warc.Wanted({"record_id": {"urn:page:1"}}, {}, True))
    assert row[7] == payload and stream.taken < len(data) / 2


def test_a_file_that_ends_early():
    record = warc.record("urn:page:1", "response", DATE, "http://h/", DIGEST, 50_000, b"x" * 50_000, None)
    for data in (record[:30_000], warc.member(record)[:100]):
        with pytest.raises(ValueError, match="ends early"):
            list(warc.read_records(Counted(data), "a", warc.Wanted({}, {}, True)))


def test_long_and_odd_rows(spark, tmp_path):
    """A payload of over 4 MB, a very long target, nulls, repeated rows, and columns named as the archive's."""
    big, url = "é" * 2_500_000, "http://h/" + noise(9000)
    pages = spark.createDataFrame([(1, url, big, "a", "b"), (1, url, big, "a", "b"), (4, None, big, None, None), (None, url, None, "a", "b")], "page_id long, url string, html string, payload string, record_type string").repartition(2)
    path = f"file://{tmp_path}/odd"
    warc.write(warc.archive(pages), path)
    found = warc.read(spark, path).select(warc.key_of(F.col("record_id")).alias("k"), "record_type", F.octet_length("payload").alias("n"), warc.key_of(F.col("refers_to")).alias("r"), F.length("target_uri").alias("u")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, "response", 5_000_000, None, len(url))] * 2 + [(4, "revisit", 0, 1, None), (None, "response", 0, None, len(url))], key=repr)
    sizes = warc.read(spark, path, payload=False).select(F.col("http_headers")["content-length"].alias("n")).collect()
    assert sorted(r["n"] for r in sizes) == ["0", "5000000", "5000000", "5000000"]
