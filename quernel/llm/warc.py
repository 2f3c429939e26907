"""WARC archives: writing with segmented records and revisits, and reading with reassembly.

Writing: each row becomes a response (HTTP header and chunked body) or, where an equal payload exists under a larger
page_id, a revisit that refers to it. A block over segment_bytes goes on in continuation records, which name their origin
(WARC-Segment-Origin-ID), their number, and in the last one the total length. Records are gzip members, packed into
archives of bounded size.

Reading: records are parsed from the archives, continuation records are grouped by origin, ordered by segment number,
their total length is verified, and chunked transfer framing is decoded. A record with a missing or repeated segment, or
of another length, has the status "incomplete" and no payload figures.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:quernel:warc")
_RECORDS = "record_id string, kind string, origin_id string, segment int, total_length bigint, page_key string, refers_to string, digest string, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = 16_384) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in (body[i : i + size] for i in range(0, len(body), size))) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body inside chunked framing; ValueError where the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        chunk = framed[end + 2 : end + 2 + size]
        if len(chunk) != size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(chunk)
        at = end + 4 + size


def response_id(page_key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_key} {digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8") + block + b"\r\n\r\n") + packer.flush()


def _clean(value: str) -> str:
    return "".join(" " if c in "\r\n" else c for c in value)


def records_of(page_key: str, url: str, payload: bytes, refers: str | None, unique: str, segment_bytes: int) -> Iterator[bytes]:
    """The gzip members of one row."""
    digest = base32_sha1(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    # A row that repeats its page_id and payload has a number of its own, so that its segments never mix with another's.
    own = response_id(page_key, digest) if refers is None else f"<urn:uuid:{uuid.uuid5(_SPACE, unique)}>"
    first = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Key", page_key), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record([*first, profile, ("WARC-Refers-To", response_id(refers, digest)), ("X-Refers-To-Page", refers)], head)
        return
    block = head + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record(first, block)
        return
    origin = f"<urn:uuid:{uuid.uuid5(_SPACE, unique)}>"
    first[1] = ("WARC-Record-ID", origin)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([*first, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{unique} {n}')}>"), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(n))]
        yield _record(more + [("WARC-Segment-Total-Length", str(len(block)))] * (n == len(parts)), part)


#: Numbers of payload sums that are sent out before pages are joined with the sums of repeated payloads.
BUCKETS = 1 << 20


def write_archives(pages: DataFrame, scratch: Scratch, segment_bytes: int = 65_536, archive_bytes: int = 4_000_000, least_payload: int = 0) -> DataFrame:
    """Archives (archive string, content binary) of the rows (page_id, url, html).

    Null html is an empty payload, a null url an empty one. Of rows with equal payloads of at least least_payload bytes
    the one with the largest page_id is the response; rows that repeat that page_id are responses too. Null page_ids
    count as the smallest. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("sum", F.concat(F.sha1("html"), F.octet_length("html").cast("string")))
    # Only sums travel for the choice of the response, partly aggregated; a hot payload is one row for each task. The choice is
    # written, so that the join below reads both sides from plain exchanges and Spark can split a hot payload's pages.
    last = scratch.keep(rows.where(F.octet_length("html") >= least_payload).groupBy("sum").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # Buckets of those sums are BUCKETS rows at most, whatever the input, so they may be broadcast: pages whose payload can't be
    # repeated are not moved.
    bucket = F.pmod(F.xxhash64("sum"), F.lit(BUCKETS)).alias("bucket")
    marks = F.broadcast(last.select(bucket).distinct())
    keyed = rows.select("*", bucket)
    met = keyed.join(marks, "bucket", "left_semi").join(last, "sum", "left").select("page_id", "url", "html", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers"))
    rows = met.unionByName(keyed.join(marks, "bucket", "left_anti").select("page_id", "url", "html", F.lit(None).cast("bigint").alias("refers")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, count, held, size = uuid.uuid4().hex, 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"{seed}-{count:08d}"], "content": [b"".join(held)]})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page, url, html, refers in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    count += 1
                    for record in records_of("" if page is None else str(page), url, html, None if refers is None else str(refers), f"{seed} {count}", segment_bytes):
                        if size + len(record) > archive_bytes and held:
                            yield archive()
                            held, size = [], 0
                            count += 1
                        held.append(record)
                        size += len(record)
        if held:
            yield archive()

    return rows.mapInArrow(tidy(write), "archive string, content binary")


def members_of(content: bytes, step: int = 65_536) -> Iterator[bytes]:
    """The gzip members of an archive, or all of it where it is plain; each byte is read once."""
    view, at = memoryview(content), 0
    while at < len(view):
        if view[at : at + 2] != b"\x1f\x8b":
            yield bytes(view[at:])
            return
        member, out = zlib.decompressobj(31), []
        while not member.eof and at < len(view):
            part = view[at : at + step]
            out.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
        yield b"".join(out)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, gzip members or plain."""
    for record in members_of(content):
        at = 0
        while at < len(record):
            end = record.index(b"\r\n\r\n", at)
            lines = record[at:end].decode("utf-8").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            start, length = end + 4, int(headers["content-length"])
            yield headers, record[start : start + length]
            at = start + length + 4


def read_records(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives."""
    names = [x.split()[0] for x in _RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in parse_archive(content.as_py()):
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-segment-origin-id") or (h.get("warc-record-id") if number else None), int(number) if number else None, int(total) if total else None, h.get("x-page-key"), h.get("x-refers-to-page"), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names=names)

    return archives.select("content").mapInArrow(tidy(read), _RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """page_key, record_type, refers_to, status, payload_bytes, payload_digest: one row for each whole record.

    The segments of one record meet in one task; they are one row's payload, never a group of rows.
    """
    single = records.where("origin_id is null").select("kind", "page_key", "refers_to", "digest", F.array(F.struct(F.lit(1).alias("n"), F.lit(None).cast("bigint").alias("total"), "block")).alias("parts"))
    split = records.where("origin_id is not null").groupBy("origin_id").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("kind", "page_key", "refers_to", "digest"))).alias("head"), F.collect_list(F.struct(F.col("segment").alias("n"), F.col("total_length").alias("total"), "block")).alias("parts")
    ).select("head.*", "parts")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, key, refers, said, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = sorted(parts, key=lambda p: p["n"] or 0)
                block, totals = b"".join(p["block"] for p in parts), [p["total"] for p in parts if p["total"] is not None]
                whole = kind is not None and [p["n"] for p in parts] == [*range(1, len(parts) + 1)] and (totals == [len(block)] if len(parts) > 1 else totals in ([], [len(block)]))
                size, digest = None, said
                if whole and kind == "response":
                    head, _, body = block.partition(b"\r\n\r\n")
                    try:
                        body = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                        size, digest = len(body), base32_sha1(body)
                        whole = digest == said
                    except ValueError:
                        whole = False
                out.append((key, kind, refers, "whole" if whole else "incomplete", size, digest))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, [pa.string()] * 4 + [pa.int64(), pa.string()], strict=True)], names=["page_key", "record_type", "refers_to", "status", "payload_bytes", "payload_digest"])

    return single.unionByName(split).mapInArrow(tidy(join), "page_key string, record_type string, refers_to string, status string, payload_bytes bigint, payload_digest string")


def round_trip(pages: DataFrame, scratch: Scratch, **options: int) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and status of every row: the pages written as archives and
    read back, where a revisit has its payload's figures from its response.

    Null html is an empty payload, however long payloads are; nulls, repeated rows and ties are as in write_archives; other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    archives = scratch.keep(write_archives(pages, scratch, **options))
    found = scratch.keep(reassemble(read_records(archives)))
    scratch.free(archives)
    key = F.when(F.col("page_key") != "", F.col("page_key").cast("bigint"))
    whole = found.where("record_type = 'response'").select(key.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"), "status")
    # A response is named by its page and digest; rows that repeat it are one target.
    target = found.where("record_type = 'response' and status = 'whole'").select(F.col("page_key").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    # Written, so that Spark can split the revisits of a hot payload in the join.
    target = scratch.keep(target)
    again = found.where("record_type = 'revisit'").select("page_key", "refers_to", "record_type", "status", "payload_digest").join(target, ["refers_to", "payload_digest"], "left")
    again = again.select(key.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint"), F.when(F.col("payload_bytes").isNull(), "incomplete").otherwise(F.col("status")).alias("status"))
    return whole.unionByName(again)
