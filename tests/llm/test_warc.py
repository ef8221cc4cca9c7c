import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from framewarden.llm import warc

MARKS = (warc.MARK, warc.GZIP_MARK)


def test_chunked_framing_round_trip():
    ends = [b"x" * 40 + m[:n] for m in MARKS for n in range(len(m) + 1)]
    for payload in (b"", b"x", os.urandom(100_000), warc.MARK * 50 + b"tail", b"WARC/1.1\r" * 9, warc.VERSION * 30, *ends):
        for size in (7, 8, 40, 48, 1 << 14):
            body = warc.chunked(payload, size)
            assert warc.dechunk(body) == payload and warc.VERSION not in body
    for bad in (b"", b"5\r\nab", b"zz\r\nab\r\n0\r\n\r\n", b"-1\r\n\r\n"):
        assert warc.dechunk(bad) is None


def test_members():
    for record in (b"", b"x" * 1000, os.urandom(5000), warc.GZIP_MARK * 20, warc.MARK + b"\r\n"):
        data = warc.member(record)
        assert data.startswith(warc.GZIP_MARK) and data.count(warc.GZIP_MARK) == 1 and data[-1] == 0
        assert warc.unpack(data[len(warc.GZIP_MARK) :]) == record
        import gzip

        assert gzip.decompress(data + data) == record * 2
        assert warc.unpack(data[len(warc.GZIP_MARK) : -3]) == b""
    assert warc.unpack(b"not deflated") == b""
    with pytest.raises(ValueError):
        warc.member(b"x" * (1 << 24))


ROWS = [(1, "u", "a" * 1000), (2, "u", "a" * 1000), (3, None, "a" * 1000), (4, "u", "short"), (5, "u", "short"), (6, "u\r\nWARC/1.1\r\n", None), (7, "u", ""), (8, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 400), (9, "u", "é日本" * 5000), (9, "u", "é日本" * 5000), (None, "u", "no id")]
#: Payloads, chunks and segments that end in each prefix of the mark.
ENDS = [(100 + n, "u", "y" * (size - n) + "WARC/1.1\r\n"[:n]) for size in (900, warc.CHUNK, warc.CHUNK * 2) for n in range(11)]
ENDS = [(i * 7 + 1000, u, t) for i, (_, u, t) in enumerate(ENDS)]
RNG = random.Random(1)
LONG = [(5000 + i, "u", "".join(RNG.choice(["WARC/1.1", "\r\n", "x", "yy"]) for _ in range(9000))) for i in range(3)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("segment", [700, 701, warc.SEGMENT])
@pytest.mark.parametrize("gzip", [True, False])
def test_round_trip_with_segments(spark, segment, gzip):
    rows = ROWS + ENDS + LONG
    got = warc.archive_round_trip(pages(spark, rows), segment=segment, gzip=gzip).collect()
    assert len(got) == len(rows) and all(r.valid for r in got)
    by_id = {r.page_id: r for r in got}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        r = by_id[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
    assert {i: by_id[i].refers_to for i in (1, 2, 3, 4, 5, 9)} == {1: 3, 2: 3, 3: None, 4: None, 5: None, 9: None}
    assert by_id[1].record_type == "revisit" and by_id[3].record_type == "response"


def test_broken_segments_are_told(spark, tmp_path):
    warc.write_archives(pages(spark, ROWS), str(tmp_path / "w"), segment=700)
    records = warc.read_archives(spark, str(tmp_path / "w"))
    number = F.col("headers")["warc-segment-number"]
    lost = warc.reassemble(records.where(number.isNull() | (number != "2")))
    assert lost.where("not complete").count() >= 2
    doubled = warc.reassemble(records.union(records.where(number == "2")))
    assert doubled.where("not complete").count() >= 2
    assert warc.archive_round_trip(pages(spark, ROWS).limit(0)).count() == 0


def test_a_damaged_payload_has_no_digest(spark, tmp_path):
    warc.write_archives(pages(spark, [(1, "u", "a" * 2000), (2, "u", "a" * 2000), (3, "u", "b")]), str(tmp_path / "w"), gzip=False)
    for f in (tmp_path / "w").glob("part-*"):
        f.with_name(f".{f.name}.crc").unlink()
        f.write_bytes(f.read_bytes().replace(b"a" * 1999, b"a" * 1998 + b"z"))
    got = {r.page_id: r for r in warc.pages_of(spark, str(tmp_path / "w"), gzip=False).collect()}
    assert not got[1].valid and got[1].payload_digest is None and got[1].record_type == "revisit"
    assert not got[2].valid and got[2].payload_digest not in (None, hashlib.sha1(b"a" * 2000).hexdigest())
    assert got[3].valid and got[3].payload_bytes == 1
