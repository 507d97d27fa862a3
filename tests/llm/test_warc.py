"""WARC writing, normalising and reading against the pages themselves."""

import base64
import gzip
import hashlib
import io
import zlib

import pytest

from crestline.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, file string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


ROWS = [(1, "http://a/ é\r\nX: y", "<p>one</p>"), (2, None, None), (3, "http://b", ""), (4, "u", "<p>one</p>"), (0, "u", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (5, "u", "<p>one</p>"), (9, "big", "x" * 300_000), (9, "big", "x" * 300_000), (None, "n", "lonely"), (None, "n", "<p>one</p>")]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h or "")
        revisit = to is not None and to != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_archive_pages(spark):
    assert sorted(map(tuple, warc.archive_pages(pages_of(spark, ROWS)).collect()), key=str) == expected(ROWS)


def test_members_stand_alone_and_payloads_come_back(spark, tmp_path):
    rows = [r for r in ROWS if r[0] != 9]
    mono = warc.write_monolithic(warc.with_revisits(pages_of(spark, rows)), str(tmp_path / "m"))
    manifest = warc.normalise(mono, str(tmp_path / "n"))
    assert sum(r.n_records for r in manifest.collect()) == len(rows)
    for r in manifest.collect():
        data = open(r.file, "rb").read()
        entries = [tuple(map(int, x.split())) for x in open(r.index_file)]
        assert [a for a, _ in entries] == [0, *(a + n for a, n in entries)][:-1] and sum(n for _, n in entries) == len(data)
        for a, n in entries:
            assert zlib.decompress(data[a : a + n], 31).startswith(b"WARC/1.1\r\n")
    got = {r.page_id: r.payload for r in warc.read_records(manifest, payloads=True).filter("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert {k: bytes(v).decode() for k, v in got.items()} == {1: "<p>one</p>", 2: "", 0: ROWS[4][2]}


def test_small_payloads_can_stay_responses(spark):
    got = warc.with_revisits(pages_of(spark, [(1, "a", ""), (2, "b", None), (3, "c", "xx"), (4, "d", "xx")]), 1).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: None, 4: 3}


def test_damaged_archives_are_refused():
    body = warc.record_head("response", 1, "u", warc.digest_of(b"abc"), 3, None, len(warc.http_head(3)) + 3) + warc.http_head(3) + b"abc\r\n\r\n"
    assert warc.parse_record(body)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(body.replace(b"abc\r\n", b"abd\r\n"))
    for broken in (body[:-12], b"junk" + body, body[:30]):
        with pytest.raises(ValueError):
            warc.normalise_file(io.BytesIO(gzip.compress(broken)), io.BytesIO(), io.BytesIO())
    with pytest.raises((EOFError, zlib.error)):
        warc.normalise_file(io.BytesIO(gzip.compress(body)[:-20]), io.BytesIO(), io.BytesIO())


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0
