"""Archives that break off, are no archives or hold records with bad numbers."""

import gzip
import random

import pytest

from lectern.llm import warc


def _record(page, payload, extra=""):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{page}>\r\nPage-ID: {page}\r\n{extra}"
    return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.fixture(scope="module")
def noise():
    return random.Random(1).randbytes(40_000)


def _read(spark, tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.gz").write_bytes(data)
    rows = warc.read_records(spark, str(tmp_path)).select("page_id", "error").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_whole_archives_of_several_members(spark, tmp_path):
    found = _read(spark, tmp_path, a=gzip.compress(_record(1, b"x")) + gzip.compress(_record(2, b"")), b=gzip.compress(b""))
    assert found == [(1, None), (2, None)]


def test_an_archive_that_breaks_off(spark, tmp_path, noise):
    data = gzip.compress(_record(1, b"first") + _record(2, noise))
    assert _read(spark, tmp_path, cut=data[: len(data) // 2], ok=gzip.compress(_record(3, b"y"))) == [
        (1, None), (2, "truncated"), (3, None),
    ]


def test_a_break_between_records_and_inside_a_head(spark, tmp_path):
    whole = gzip.compress(_record(1, b"first"))
    other = gzip.compress(_record(2, b"second"))
    assert _read(spark, tmp_path, between=whole + other[:9]) == [(1, None), (None, "truncated")]


def test_a_damaged_member(spark, tmp_path, noise):
    data = bytearray(gzip.compress(_record(1, b"x")) + gzip.compress(_record(2, noise)))
    data[-20_000:-19_000] = b"\xff" * 1000
    found = _read(spark, tmp_path, damaged=bytes(data))
    assert found[0] == (1, None) and {e for _, e in found[1:]} == {"truncated"}


def test_bad_numbers_and_no_archive(spark, tmp_path):
    rows = [
        _record(1, b"a"),
        _record(2, b"b", "WARC-Segment-Number: one\r\n"),
        _record(3, b"c", "WARC-Segment-Number: 99999999999\r\n"),
        _record("x", b"d"),
        _record(4, b"e", "WARC-Segment-Total-Length: 1.5\r\n"),
        _record(5, b"f"),
    ]
    found = _read(spark, tmp_path, odd=gzip.compress(b"".join(rows)), none=gzip.compress(b"no archive"))
    assert found == [(1, None), (5, None)] + [(None, "bad_record")] * 5
    responses = warc.decode_payloads(warc.reassemble(warc.read_records(spark, str(tmp_path)))).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in responses) == [(1, b"a"), (5, b"f")]
