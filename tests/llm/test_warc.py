import gzip

import pytest

from tests.conftest import SF
from tidemark.llm import warc
from tidemark.llm.common import shared_dir


def brute(rows, least=0):
    best = {}
    for page_id, html in rows:
        p = (html or "").encode()
        key = -(1 << 63) if page_id is None else page_id
        best[p] = max(best.get(p, key), key)
    out, seen = [], set()
    for page_id, html in rows:
        p = (html or "").encode()
        key = -(1 << 63) if page_id is None else page_id
        first = len(p) < least or (best[p] == key and (key, p) not in seen)
        seen.add((key, p))
        refers = None if first or best[p] == -(1 << 63) else best[p]
        out.append((page_id, len(p), warc.digest(p), "response" if first else "revisit", refers))
    return sorted(out, key=str)


def read(spark, pages, least=0):
    folder = shared_dir(spark, "t")
    warc.write_archives(pages, folder, least)
    return warc.read_archives(spark, folder)


def digested(df):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


@pytest.mark.parametrize("least", [0, 1500])
def test_pages(spark, least):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    got = read(spark, pages, least)
    assert digested(got) == brute(rows, least)
    html = dict(rows)
    assert all(bytes(r.payload) == html[r.page_id].encode() for r in got.filter("record_type = 'response'").collect())


def test_segments_over_many_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 64)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    rows = [(i, f"http://x/{i}", "é\r\n\r\n" * (i * 7 % 400)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert digested(read(spark, pages)) == brute([(r[0], r[2]) for r in rows])


def test_hard_rows(spark):
    rows = [(1, None, None), (2, "u\r\nv", ""), (None, "n", "x"), (None, None, "x"), (3, "a", "x"), (3, "b", "x"), (3, "a", "x")]
    rows += [(5, "a", "long " * 100000), (6, "a", "long " * 100000), (None, "q", "alone")]
    extra = [(*r, "extra", 9) for r in rows]
    pages = spark.createDataFrame(extra, "page_id long, url string, html string, digest string, kid long")
    assert digested(read(spark, pages)) == brute([(r[0], r[2]) for r in rows])
    assert read(spark, pages.limit(0)).count() == 0


def test_missing_segment_is_an_error(spark, tmp_path):
    parts = warc.page_records("7", 0, "u", b"x" * 80000, None)
    assert len(parts) > 3
    (tmp_path / "a.warc").write_bytes(b"".join(parts[:2] + parts[3:]))
    with pytest.raises(Exception, match="missing|INVALID|segments"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()
    (tmp_path / "a.warc").write_bytes(b"".join(parts[:-1]))
    with pytest.raises(Exception):  # noqa: B017
        warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_chunked_framing():
    for n in (0, 1, 999, 1000, 1001, 5000):
        assert warc.unchunked(warc.chunked(b"a" * n)) == b"a" * n
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")


def test_members_are_not_copied_for_each_other(spark, monkeypatch):
    """An archive has a member for each record; reading one must not copy all that follow it."""
    parts = [warc.record({"WARC-Type": "response", "N": str(i)}, b"%d " % i * (i % 50)) for i in range(400)]
    packed = b"".join(gzip.compress(p, 1, mtime=0) + b"\0" * (i % 3) for i, p in enumerate(parts))
    fed, make = [], warc.zlib.decompressobj

    class Member:
        def __init__(self, **kw):
            self.own = make(**kw)

        def decompress(self, part):
            fed.append(len(part))
            return self.own.decompress(part)

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Member)
    for size in (64, 1000, 4096):
        monkeypatch.setattr(warc, "MEMBER_BYTES", size)
        fed.clear()
        assert b"".join(parts) == warc.unzipped(packed) and sum(fed) <= len(packed) + len(parts) * size
    assert [h["n"] for h, _ in warc.records(packed)] == [str(i) for i in range(400)]
    with pytest.raises(EOFError):
        warc.unzipped(packed[:-40])
