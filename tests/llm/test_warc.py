import hashlib
from contextlib import contextmanager

import pytest

from chalkline.llm import warc
from tests.llm.conftest import with_clashes

SCHEMA = "page_id long, url string, html string"
FORGED = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nX-Page-Id: 666\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [(1, "http://a/1", "x" * 150), (2, "http://a/2", "x" * 150), (3, None, None), (4, "http://a/\r\nX-Page-Id: 9", ""),
        (5, "http://b/5", "short"), (6, "http://b/6", "short"), (7, "u", "ends in magic WARC/1."), (8, "u", "WARC/1.1\r\n begins " + "y" * 400),
        (9, "u", FORGED), (10, "u", "a" * 300 + FORGED * 30 + "WARC/1.0" * 200), (11, "ü", "é😀" * 90), (0, "u", "é😀" * 90),
        (None, "n", "é😀" * 90), (None, "n", "z" * 200), (None, "n", "z" * 200), (12, "r", "w" * 100), (12, "r", "w" * 100), (13, "r", "w" * 100),
        (14, "r", "w" * 99), (15, "r", "w" * 99), (16, "big", "long " * 20_000 + "WARC/1.1\r\n" + "tail " * 3_000), (17, "g", "\r\n\r\n" * 60)]


def expected(rows):
    out, by = [], {}
    for page_id, _, html in rows:
        by.setdefault((html or "").encode(), []).append(page_id)
    for payload, ids in by.items():
        digest = hashlib.sha256(payload).hexdigest()
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for i, page_id in enumerate(ids):
            revisit = len(payload) >= 100 and i > 0
            out.append((page_id, len(payload), digest, "revisit" if revisit else "response", ids[0] if revisit else None))
    return sorted(out, key=repr)


@contextmanager
def splits_of(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def read_back(spark, path):
    found = warc.resolved(warc.read_archives(spark, str(path)))
    rows = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()
    assert all(r["intact"] for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=repr)


@pytest.mark.parametrize("size", ["2000", "128m"])
def test_round_trip_at_any_split(spark, tmp_path, size):
    pages = with_clashes(spark.createDataFrame(ROWS, SCHEMA))
    warc.write_archives(pages.coalesce(2), str(tmp_path / "a"))
    with splits_of(spark, size):
        assert read_back(spark, tmp_path / "a") == expected(ROWS)


def test_archive_is_plain_warc(spark, tmp_path):
    """A reader that follows Content-Length from the file's start sees the records, without Spark."""
    pages = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    ids = []
    for file in (tmp_path / "a").glob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            end = data.index(b"\r\n\r\n", at)
            head = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
            ids.append(head.get(b"X-Page-Id"))
            at = end + 4 + int(head[b"Content-Length"]) + 4
            assert data[at - 4:at] == b"\r\n\r\n"
    assert sorted(filter(None, ids), key=int) == [str(r[0]).encode() for r in sorted(r for r in ROWS if r[0] is not None)]


def raw(kind, block, more=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(block)}\r\n{more}\r\n{block}\r\n\r\n".encode()


def test_foreign_archives(spark, tmp_path):
    """Other record types and versions, a file without records, broken chains, a cut-off record."""
    whole = raw("warcinfo", "software: x") + raw("resource", "payload one", "X-Page-Id: 1\r\n") + raw("resource", FORGED, "X-Page-Id: 2\r\n")
    (tmp_path / "good.warc").write_bytes(whole)
    (tmp_path / "late.warc").write_bytes(b"garbage" + whole)
    (tmp_path / "cut.warc").write_bytes(whole + raw("resource", "c" * 500, "X-Page-Id: 3\r\n")[:-200])
    (tmp_path / "broken.warc").write_bytes(raw("resource", "first", "X-Page-Id: 4\r\n") + b"noise" + whole)
    (tmp_path / "none.warc").write_bytes(b"")
    for size in ("60", "128m"):
        with splits_of(spark, size):
            rows = warc.read_archives(spark, str(tmp_path)).collect()
        got = sorted((r["file"].rsplit("/")[-1], r["page_id"], r["record_type"], r["payload_bytes"]) for r in rows if r["page_id"])
        good = [(1, "resource", 11), (2, "resource", len(FORGED))]
        assert got == sorted([(f, *x) for f in ("good.warc", "cut.warc") for x in good] + [("broken.warc", 4, "resource", 5)])
        assert [r["payload_digest"] for r in rows if r["page_id"] == 2] == [hashlib.sha256(FORGED.encode()).hexdigest()] * 2


def test_empty_and_real(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert read_back(spark, tmp_path / "none") == []
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    warc.write_archives(pages, str(tmp_path / "a"))
    with splits_of(spark, "40k"):
        assert read_back(spark, tmp_path / "a") == expected([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
