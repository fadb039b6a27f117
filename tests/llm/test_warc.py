"""WARC archives: streams, members, offsets and revisits."""

import base64
import gzip
import hashlib
import zlib
from pathlib import Path

import pytest

from tests.compare import duckdb_over, duckdb_rows, spark_rows
from tests.llm.fixtures import FOLDER
from tracemill.llm import warc
from tracemill.llm.queries import ORACLE_SQL, op3_warc_normaliser

PAGES = "page_id long, url string, html string"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parts(folder):
    return [p.read_bytes() for p in sorted(Path(folder).glob("part-*"))]


def test_equals_duckdb(spark):
    assert spark_rows(op3_warc_normaliser(spark, FOLDER)) == duckdb_rows(duckdb_over(FOLDER), ORACLE_SQL["op3_warc_normaliser"])


def test_streams_become_members(spark, tmp_path):
    table = [(i, f"http://a.example/{i} \r\nx", f"<p>é {i // 3} " + "text " * (i % 50)) for i in range(90)]
    pages = spark.createDataFrame(table, PAGES).repartition(3)
    index = warc.archive(pages, str(tmp_path)).collect()
    streams, archives = parts(tmp_path / "streams"), parts(tmp_path / "archives")
    for stream in streams:  # one gzip stream each
        one = zlib.decompressobj(31)
        one.decompress(stream)
        assert one.eof and not one.unused_data
    records = lambda files: sorted(r for f in files for r in warc.records(warc.inflated(f)))
    assert records(streams) == records(archives)
    assert len(index) == 90 and sum(r.length for r in index) == sum(map(len, archives))
    html = {i: h for i, _, h in table}
    for r in index:
        content = Path(r.archive.removeprefix("file:")).read_bytes()
        headers, block = warc.read_record(content, r.offset, r.length)
        assert gzip.decompress(content[r.offset : r.offset + r.length]).startswith(b"WARC/1.1\r\n")
        payload = html[r.page_id].encode()
        assert headers["warc-type"] == r.record_type and block == (payload if r.record_type == "response" else b"")
        assert (r.payload_bytes, r.payload_digest) == (len(payload), digest(payload))
        lowest = min(i for i, h in html.items() if h == html[r.page_id])
        assert r.refers_to == (lowest if lowest != r.page_id else None)
        assert r.url == f"http://a.example/{r.page_id}%20%0D%0Ax"


def test_files_hold_a_bounded_number_of_records(spark, tmp_path):
    pages = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "string(id) AS html").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "s"), records=20)
    assert sorted(gzip.decompress(p).count(b"WARC/1.1\r\n") for p in parts(tmp_path / "s")) == [10, 20, 20]


def test_small_payloads_may_be_kept_whole(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(["a", "a", "long text", "long text"])], PAGES)
    warc.write_archives(pages, str(tmp_path / "s"), least_bytes=5)
    assert b"".join(map(gzip.decompress, parts(tmp_path / "s"))).count(b"WARC-Type: revisit") == 1


@pytest.mark.parametrize("size", [0, 10, (1 << 24) - 1, 1 << 24, (1 << 24) + 5])
def test_members_end_in_zero(size):
    """Records of 16 MiB and more get an empty member behind them, which belongs to them."""
    head = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % size
    record = head + b"x" * size + b"\r\n\r\n"
    small = b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    content = b"".join(warc.member(r) + b"\0" for r in (small, record, small))
    assert gzip.decompress(content) == small + record + small
    found = list(warc.entries(content))
    assert [len(e.block) for e in found] == [0, size, 0]
    assert found[1].offset == found[0].length and found[2].offset == found[1].offset + found[1].length
    assert list(warc.records(warc.inflated(content))) == [small, record, small]


def test_a_cut_archive_is_refused():
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))


def test_odd_rows(spark):
    table = [(1, None, None), (2, "u", ""), (None, "u", ""), (3, "u", "a\r\n\r\nb\0c"), (3, "u", "a\r\n\r\nb\0c"), (4, "u", "a\r\n\r\nb\0c"), (2, "u", "other"), (9, "u", "word " * 100_000), (None, None, None)]
    pages = spark.createDataFrame(table, PAGES).selectExpr("*", "'clash' AS digest", "1 AS mark", "2 AS refers_to")
    found = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=repr)
    assert found == sorted([
        (1, 0, "response", None), (2, 0, "revisit", 1), (None, 0, "response", None), (3, 8, "response", None), (3, 8, "response", None),
        (4, 8, "revisit", 3), (2, 5, "response", None), (9, 500_000, "response", None), (None, 0, "response", None),
    ], key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0
