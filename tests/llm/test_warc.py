import gzip
import hashlib
import io
from pathlib import Path

import pytest

from longbox.llm import warc

DDL = "page_id BIGINT, url STRING, html STRING, digest STRING"
DATE = "2024-01-01T00:00:00Z"


def run(spark, rows):
    return warc.write_archives(spark.createDataFrame(rows, DDL), DATE)


def test_pages_read_back(spark):
    big, other = "é" * 500, "x" * 999
    rows = [(1, "http://a/1", big, "x"), (7, "http://a/7", big, "x"), (3, None, big, "x"), (4, "http://a/\r\nX: %41", other, "x"), (5, "u", other, "x"),
            (6, "u", None, "x"), (8, "u", "", "x"), (None, "u", big, "x"), (9, "u", "y" * 300_000 + "\r\n\r\n", "x"), (7, "again", big, "x")]
    archives = run(spark, rows)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_archives(archives).collect()
    for r in got:
        html = next(h or "" for i, u, h, _ in rows if (i, u) == (r["page_id"], r["url"])).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha1(html).hexdigest())
        revisit = html == big.encode() and r["page_id"] != 7
        assert (r["record_type"], r["refers_to"]) == (("revisit", 7) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else html)
    assert sorted((repr(r["page_id"]), repr(r["url"])) for r in got) == sorted((repr(r[0]), repr(r[1])) for r in rows)


def test_no_pages(spark):
    assert warc.read_archives(run(spark, [])).count() == 0


def test_archives_are_full_at_a_size_and_one_member_per_record(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    archives = run(spark, [(i, "u", f"page {i}", "x") for i in range(5)])
    paths = [r["path"] for r in archives.collect()]
    assert len(paths) == 5
    data = b"".join(Path(p).read_bytes() for p in paths)
    assert data.count(b"\x1f\x8b\x08") == 5 and gzip.decompress(data).count(b"WARC/1.1\r\n") == 5
    assert len(list(warc.Reader(io.BytesIO(data).read))) == 5


def test_damage_is_found():
    page = {"page_id": 1, "url": "u", "payload": b"abc" * 100, "n": 300, "digest": hashlib.sha1(b"abc" * 100).hexdigest(), "refers_to": None}
    good = warc.record(page, DATE)
    assert [warc.page_of(*r)["payload"] for r in warc.Reader(io.BytesIO(good * 2).read)] == [b"abc" * 100] * 2
    text = gzip.decompress(good)
    for bad, error in ((good[:-20], EOFError), (gzip.compress(text.replace(b"abcabc", b"abcabd", 1)), ValueError), (gzip.compress(text[:-1]), EOFError), (gzip.compress(text + b"x"), ValueError)):
        with pytest.raises(error):
            list(warc.Reader(io.BytesIO(bad).read))
    wrong = warc.record(page | {"digest": "00" * 20}, DATE)
    with pytest.raises(ValueError):
        [warc.page_of(*r) for r in warc.Reader(io.BytesIO(wrong).read)]
