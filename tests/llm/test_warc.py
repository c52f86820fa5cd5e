import gzip
import io
import zlib

import pytest

from loomstone.llm import warc
from loomstone.llm.common import scratch


def test_round_trip_with_copies_nulls_and_ties(spark):
    pages = spark.createDataFrame([(1, "u", "a", 9), (2, "v", "a", 9), (3, None, None, 9), (4, "w", "", 9), (None, "z", "a", 9), (2, "v", "a", 9), (5, "u", "é" * 100_000, 9)], "page_id long, url string, html string, sha long")
    path = warc.write_warc(pages, scratch(spark, "t"))
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.digest_ok) for r in warc.read_warc(spark, path).collect()}
    assert got == {(1, "revisit", 2, 1, None), (2, "response", None, 1, True), (3, "revisit", 4, 0, None), (4, "response", None, 0, True), (None, "revisit", 2, 1, None), (5, "response", None, 200_000, True)}
    assert warc.read_warc(spark, path).count() == 7
    long = warc.read_warc(spark, path).filter("record_id = 5").first()
    assert bytes(long.payload).decode() == "é" * 100_000 and long.payload_digest == warc.sha1_base32(bytes(long.payload))


def test_small_payloads_may_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "a"), (3, "v", "long"), (4, "v", "long")], "page_id long, url string, html string")
    path = warc.write_warc(pages, scratch(spark, "t"), min_revisit=2, archive_bytes=1)
    assert sorted((r.record_id, r.record_type) for r in warc.read_warc(spark, path).collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(spark, warc.write_warc(pages, scratch(spark, "t"))).count() == 0


def archive():
    return b"".join(warc.page_record(i, "u", p, warc.sha1_base32(p), len(p), None) for i, p in enumerate([b"one", b"", b"x" * 300_000]))


def test_archives_are_plain_gzip_and_padding_is_skipped():
    data = archive()
    assert gzip.decompress(data).count(b"WARC/1.1") == 3
    records = list(warc.read_records(io.BytesIO(data + b"\0" * 70_000)))
    assert [r.length for r in records] == [3, 0, 300_000] and all(r.digest_ok for r in records)


@pytest.mark.parametrize("cut", [10, 100, 400])
def test_truncation_is_an_error(cut):
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(archive()[:-cut])))


def test_wrong_digest_and_wrong_length_are_seen():
    bad = warc.page_record(1, "u", b"abc", warc.sha1_base32(b"abd"), 3, None)
    assert [r.digest_ok for r in warc.read_records(io.BytesIO(bad))] == [False]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    framed = c.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n") + c.flush()
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(framed)))
