import gzip
import hashlib

import pytest

from quillspark.llm import warc

ROWS = [(1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (3, None, "x" * 1000), (4, "http://a/4\r\nX: y", "x" * 999), (5, "http://a/5", "x" * 999), (6, "u", None), (7, "u", ""), (8, "é", "日本\r\n\r\nmore" * 200), (None, "u", "x" * 1000), (9, "u", "WARC/1.1\r\n\r\n"), (9, "u", "WARC/1.1\r\n\r\n")]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1, "f") for r in ROWS], "page_id long, url string, html string, offset int, file string")
    folder = f"file://{tmp_path}/archive"
    index = warc.write_archive(pages, folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_records(index, folder).collect()), key=str)
    want = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        ref = 3 if i in (1, 2) else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if ref else "response", ref, None if ref else b))
    assert got == sorted(want, key=str)
    some = warc.read_records(index.where("page_id in (8, 2)"), folder).collect()
    assert {r.page_id for r in some} == {2, 8} and {r.url for r in some} == {"é", "http://a/2"}
    row = index.where("page_id = 8").first()
    with open(row.file, "rb") as f:
        f.seek(row.offset)
        assert gzip.decompress(f.read(row.length)).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_one_id_with_several_payloads(spark, tmp_path):
    """Every payload is in some response, and a revisit goes by its own payload."""
    a, b, c = "A" * 1000, "B" * 1200, "C" * 1000
    rows = [(5, "u", a), (5, "u", b), (5, "u", c), (9, "u", a), (8, "u", c), (5, "u", a)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_records(warc.write_archive(pages, f"file://{tmp_path}/a"), f"file://{tmp_path}/a").collect()
    digest = {hashlib.sha1(x.encode()).hexdigest(): x for x in (a, b, c)}
    assert sorted((r.page_id, digest[r.payload_digest][0], r.record_type, r.refers_to or 0) for r in got) == sorted([(5, "A", "revisit", 9), (5, "A", "revisit", 9), (5, "B", "response", 0), (5, "C", "revisit", 8), (9, "A", "response", 0), (8, "C", "response", 0)])
    assert {bytes(r.payload).decode() for r in got if r.payload} == {a, b, c}


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_archive(pages, f"file://{tmp_path}/a"), f"file://{tmp_path}/a").count() == 0


def test_coalesced():
    assert warc.coalesced([(0, 10), (12, 5), (100, 5), (105, 90)], gap=5, most=100) == [(0, 17, [0, 1]), (100, 195, [2, 3])]
    assert warc.coalesced([(0, 60), (60, 60)], gap=5, most=100) == [(0, 60, [0]), (60, 120, [1])]


def test_damage_is_noticed():
    record, _ = warc._record(1, "u", b"payload", None)
    bad = gzip.compress(gzip.decompress(record).replace(b"payload\r\n", b"paYload\r\n"))
    assert warc.parse_record(record)["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(bad)
