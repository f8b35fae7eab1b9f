import hashlib
import io
import os

import pytest

from tempera.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def _expected(rows):
    keep = {}
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        if len(body) >= warc.REVISIT_BYTES and page_id is not None:
            keep[body] = max(page_id, keep.get(body, page_id))
    out = []
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        copies = sum((r[2] or "").encode() == body for r in rows)
        k = keep.get(body) if copies > 1 else None
        revisit = k is not None and (page_id is None or page_id < k)
        out.append((page_id, "revisit" if revisit else "response", k if revisit else None, len(body), hashlib.sha1(body).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/1", "x" * 1000, "clash"),
    (5, "http://a/5", "x" * 1000, None),
    (5, "http://a/5", "x" * 1000, None),
    (3, "http://a/3 b\r\nc", "x" * 1000, None),
    (7, None, None, None),
    (8, "u", "", None),
    (9, "u", "y" * 999, None),
    (10, "u", "y" * 999, None),
    (11, "u", "\x1f\u008b\x08WARC/1.1\r\n\r\n" * 200, None),
    (None, "u", "z" * 5000, None),
    (None, "u", "x" * 1000, None),
    (12, "u", os.urandom(40_000).hex() * 40, None),
]


@pytest.mark.parametrize("range_bytes", [1, 97, 5000, 1 << 24])
def test_round_trip_at_any_split(spark, range_bytes):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(2)
    archives = warc.archive_pages(pages)
    if range_bytes == 1:
        archives = archives.filter("bytes < 30000")
        assert warc.read_archives(archives, range_bytes=range_bytes).count() == (archives.groupBy().sum("records").first()[0] or 0)
        return
    got = warc.read_archives(archives, payload=True, range_bytes=range_bytes).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got), key=repr) == _expected(ROWS)
    bodies = {r.payload_digest: r.payload for r in got if r.record_type == "response"}
    assert all(hashlib.sha1(b).hexdigest() == d for d, b in bodies.items())
    assert {r.url for r in got} == {"http://a/1", "http://a/5", "http://a/3%20b%0D%0Ac", "u", None}


def test_empty_table(spark):
    assert warc.read_archives(warc.archive_pages(spark.createDataFrame([], PAGES))).count() == 0


def test_false_magic_is_passed_over():
    record = warc.encode_record(4, "u", b"p" * 50, hashlib.sha1(b"p" * 50).hexdigest(), "response", None, "2000-01-01T00:00:00Z")
    import gzip

    data = b"\x1f\x8b\x08junk" + gzip.compress(b"no record") + gzip.compress(record) + b"\x1f\x8b\x08"
    for start in range(0, len(data)):
        owned = [r[0] for r in warc.records_in_range(io.BytesIO(data), start, len(data))]
        first = data.index(gzip.compress(record)[10:]) - 10
        assert owned == ([4] if start <= first else [])


def test_damaged_payload_is_reported():
    record = warc.encode_record(4, "u", b"p" * 50, "00" * 20, "response", None, "2000-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc.decode_record(record)
