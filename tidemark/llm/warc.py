"""WARC archives: written by tasks, reassembled by groups of segments (operator 9).

A page is a ``response`` record whose payload travels in chunked transfer framing, or a ``revisit`` record when another
page holds an equal payload. Blocks longer than SEGMENT_BYTES are cut: the first segment is the response, the others
are ``continuation`` records that name the first record's id, their segment number and, in the last, the total length.
Reading groups segments by that origin, orders them by number, verifies the total and takes the framing off.

Payloads of any length are cut into segments and put together again whole; an empty table gives archives without pages.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shuffles_dropped
from .common import small_batches
from .token_store import _put

SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 4096, 1000, 16 << 20
#: Compressed bytes that go to a member of an archive at a time; at most so many are copied to begin the next member.
MEMBER_BYTES = 4096
_NULL_ID = -(1 << 63)
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The body without its framing; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: dict[str, str], block: bytes) -> bytes:
    clean = {k: v.replace("\r", " ").replace("\n", " ") for k, v in headers.items()}
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in clean.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def unzipped(data: bytes) -> bytes:
    """All members of a gzip file, in time that grows with its length: ``gzip.decompress`` copies all that is left of the
    file for each member, and archives have one for each record."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        if not view[at]:  # zeros may pad a member
            at += 1
            continue
        member = zlib.decompressobj(wbits=16 + zlib.MAX_WBITS)
        while not member.eof:
            part = view[at : at + MEMBER_BYTES]
            if not part:
                raise EOFError("an archive ends within a member")
            out.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
    return b"".join(out)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, compressed or not."""
    at, data = 0, unzipped(data) if data[:2] == b"\x1f\x8b" else data
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record begins here")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = end + 4
        size = int(headers["content-length"])
        yield headers, data[start : start + size]
        at = start + size + 4


def page_records(page: str, occurrence: int, url: str | None, payload: bytes, refers_to: str | None) -> list[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    sha = digest(payload)
    origin = f"<urn:page:{page}:{sha}:{occurrence}>"
    common = {"WARC-Target-URI": url or "", "WARC-Date": _DATE, "WARC-Payload-Digest": f"sha1:{sha}"}
    common["Content-Type"] = "application/http; msgtype=response"
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        names = {"WARC-Type": "revisit", "WARC-Record-ID": origin, **common, "WARC-Profile": profile}
        return [record(names | {"WARC-Refers-To": f"<urn:page:{refers_to}:{sha}:0>"}, head)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    out = []
    for k, piece in enumerate(pieces, 1):
        names = {"WARC-Type": "response", "WARC-Record-ID": origin, **common}
        if k > 1:
            names |= {"WARC-Type": "continuation", "WARC-Record-ID": f"{origin[:-1]}:{k}>", "WARC-Segment-Origin-ID": origin}
        if len(pieces) > 1:
            names["WARC-Segment-Number"] = str(k)
            if k == len(pieces):
                names["WARC-Segment-Total-Length"] = str(len(block))
        out.append(record(names, piece))
    return out


def _id(page_id: Column) -> Column:
    return F.coalesce(page_id.cast("long"), F.lit(_NULL_ID))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Writes every page (page_id, url, html) to archives below ``folder``, which every executor reaches.

    Null html is an empty payload, a null url an empty address; a null page_id sorts before all others. Of equal
    payloads of at least ``least_bytes`` the largest page_id is the response and the others revisit it; among
    repeated rows of that page_id one is the response. Smaller payloads are responses all. Other columns are dropped.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = small_batches(pages).select(_id(F.col("page_id")).alias("kid"), "url", html.alias("html"), F.sha1(html).alias("sha"))
    best = pages.groupBy("sha").agg(F.max("kid").alias("best"))
    verdicts = pages.select("kid", "sha").distinct().join(best, "sha")
    ordered = pages.join(verdicts, ["kid", "sha"]).sortWithinPartitions("kid", "sha", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        last, occurrence, parts, size, made = None, 0, [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"pages-{task.partitionId():07d}-{made:05d}.warc.gz"
            _put(folder, name, b"".join(parts), str(task.taskAttemptId()))
            return pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size]})

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["kid"], row["sha"])
                occurrence, last = (occurrence + 1 if key == last else 0), key
                payload = row["html"].encode("utf-8", "surrogatepass")
                first = len(payload) < least_bytes or (row["kid"] == row["best"] and occurrence == 0)
                name = ["" if x == _NULL_ID else str(x) for x in (row["kid"], row["best"])]
                for r in page_records(name[0], occurrence, row["url"], payload, None if first else name[1]):
                    parts.append(gzip.compress(r, 1, mtime=0))  # a member a record, so that each can be read alone
                    size += len(r)
                    if size >= ARCHIVE_BYTES:
                        yield close()
                        parts, size, made = [], 0, made + 1
        if parts:
            yield close()

    made = ordered.select("kid", "sha", "best", "url", "html").mapInArrow(run, "archive string, bytes long")
    with shuffles_dropped(pages.sparkSession):
        made.write.parquet(f"{folder}/manifest")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["origin", "record_type", "segmented", "segment", "total", "refers_to", "digest", "url", "block"]
    for batch in batches:
        for data in batch.column("content"):
            rows, size = [], 0
            for h, block in records(data.as_py()):
                kind = h["warc-type"]
                rows.append(
                    (
                        h.get("warc-segment-origin-id", h["warc-record-id"]),
                        None if kind == "continuation" else kind,
                        "warc-segment-number" in h,
                        int(h.get("warc-segment-number", "1")),
                        int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                        h.get("warc-refers-to"),
                        h.get("warc-payload-digest", "").removeprefix("sha1:"),
                        h.get("warc-target-uri"),
                        block,
                    )
                )
                size += len(block)
                if size > 4 << 20:
                    yield _rows(rows, names)
                    rows, size = [], 0
            if rows:
                yield _rows(rows, names)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_PAGE = ["origin", "record_type", "refers_to", "digest", "url", "payload", "payload_bytes"]
_PAGE_SCHEMA = "origin string, record_type string, refers_to string, digest string, url string, payload binary, payload_bytes long"


def _payloads(blocks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of responses, verified; the length that a revisit's header tells. ``blocks`` takes the blocks of a batch."""
    for batch in batches:
        out, sizes = [], []
        for block, kind, sha in zip(blocks(batch), batch.column("record_type").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            head, _, body = block.partition(b"\r\n\r\n")
            payload, size = None, re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
            if kind == "response":
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if digest(payload) != sha:
                    raise ValueError("a payload differs from its digest")
            out.append(payload)
            sizes.append(len(payload) if payload is not None else int(size[1]) if size else None)
        kept = [batch.column(c) for c in _PAGE[:5]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], _PAGE)


def _whole(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("block").to_pylist()


def _reassembled(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The segments of each origin, by number and joined once; they must be complete and as long as the last one says."""
    for origin, total, segments in zip(*(batch.column(c).to_pylist() for c in ("origin", "total", "segments")), strict=True):
        segments = sorted(segments, key=lambda s: s["segment"])
        block = b"".join([s["block"] for s in segments])
        if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or len(block) != total:
            raise ValueError(f"segments of {origin} are missing")
        yield block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, url, payload, payload_bytes) of each page in the archives.

    A revisit has no payload of its own; its payload_bytes come from the header of the response that it keeps. Segments that do
    not add up to the stated total, broken framing and wrong digests are errors.
    """
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("pathGlobFilter", "*.warc*").load(folder).select("content")
    schema = "origin string, record_type string, segmented boolean, segment int, total long, refers_to string, digest string, url string, block binary"
    parsed = files.mapInArrow(_parsed, schema)
    parts = parsed.filter("segmented").groupBy("origin").agg(
        *[F.max(c).alias(c) for c in ("record_type", "refers_to", "digest", "url", "total")],
        F.collect_list(F.struct("segment", "block")).alias("segments"),  # one page's segments
    )
    # whole records need no partner and stay where they are read
    whole = parsed.filter("not segmented").select(*_PAGE[:5], "block").mapInArrow(partial(_payloads, _whole), _PAGE_SCHEMA)
    joined = parts.select(*_PAGE[:5], "total", "segments").mapInArrow(partial(_payloads, _reassembled), _PAGE_SCHEMA)
    pages = whole.unionByName(joined)

    def page(name: str) -> Column:
        found = F.regexp_extract(name, r"^<urn:page:(-?\d+):", 1)
        return F.when(found != "", found.cast("long"))

    return pages.select(
        page("origin").alias("page_id"),
        "record_type",
        page("refers_to").alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        "url",
        "payload",
        "payload_bytes",
    )
