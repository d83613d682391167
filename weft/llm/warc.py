"""WARC archives: writing pages with revisits and segmentation, and reading them back.

A record is a row, so Spark's text writer lays out the files: each row ends with the two line ends that close a WARC
record.  Records hold at most ``segment_bytes`` of block and files at most ``records_per_file`` records, which bounds
what a reader holds.  On reading, whole records are decoded where they stand; only continuation records are shuffled
to their origin, ordered by segment number, checked against the total length and then decoded.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import small_batches
from weft.llm.exact_dedup import MAX_FILTER_BITS, _maybe_repeated, repeated_filter
from weft.plans.runtime import materialize, new_path

SEGMENT_BYTES = 64 * 1024
RECORDS_PER_FILE = 8192
CHUNK_BYTES = 8192
LEAST_REVISIT_BYTES = 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for a in range(0, len(payload), size) if (c := payload[a : a + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The payload inside chunked framing; trailers are read over, anything malformed raises."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without size line")
        size = int(data[at:end].partition(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            break
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(data[at : at + size])
        at += size + 2
    while data[at : at + 2] != b"\r\n":
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked body is not closed")
        at = end + 2
    if at + 2 != len(data):
        raise ValueError("bytes after the last chunk")
    return b"".join(out)


def http_payload(block: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    """Body of an HTTP response after transfer decoding, and its headers."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("HTTP header is not closed")
    fields = _fields(head.split(b"\r\n")[1:])
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = unchunked(body)
    return body, fields


def _fields(lines: list[bytes]) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}


def _record(kind: bytes, record_id: bytes, block: bytes, extra: list[tuple[bytes, bytes]]) -> bytes:
    head = [(b"WARC-Type", kind), (b"WARC-Record-ID", b"<" + record_id + b">"), (b"WARC-Date", b"2024-01-01T00:00:00Z"), *extra, (b"Content-Length", b"%d" % len(block))]
    return b"WARC/1.1\r\n" + b"".join(b"%b: %b\r\n" % x for x in head) + b"\r\n" + block


def records(page_id: int | None, url: str | None, payload: bytes, digest: bytes, revisit_of: int | None, refers: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response followed by its continuations."""
    place = hashlib.sha256((url or "").encode("utf-8", "surrogatepass")).hexdigest()[:16].encode()
    own = b"urn:weft:page:%b:%b:%b" % (b"" if page_id is None else b"%d" % page_id, place, digest.hex()[:16].encode())
    target = (b"WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~").encode())
    signed = (b"WARC-Payload-Digest", b"sha256:" + digest.hex().encode())
    if revisit_of is not None:
        block = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        extra = [target, signed, (b"WARC-Profile", _PROFILE), (b"WARC-Refers-To", b"<urn:weft:page:%d:%b:%b>" % (revisit_of, refers.encode(), digest.hex()[:16].encode())), (b"Content-Type", b"application/http; msgtype=response")]
        yield _record(b"revisit", own, block, extra)
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    extra = [target, signed, (b"Content-Type", b"application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield _record(b"response", own, block, extra)
        return
    parts = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        number = (b"WARC-Segment-Number", b"%d" % k)
        if k == 1:
            yield _record(b"response", own, part, [*extra, number])
        else:
            last = [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if k == len(parts) else []
            yield _record(b"continuation", own + b":%d" % k, part, [target, (b"WARC-Segment-Origin-ID", b"<" + own + b">"), number, *last])


@F.pandas_udf(T.BinaryType())
def _payload_key(html):
    import pandas as pd

    return pd.Series([hashlib.sha256(b"" if x is None else x.encode("utf-8", "surrogatepass")).digest() for x in html], dtype=object)


@F.pandas_udf(T.StringType())
def _place(url):
    import pandas as pd

    return pd.Series([hashlib.sha256((x or "").encode("utf-8", "surrogatepass")).hexdigest()[:16] for x in url], dtype=object)


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``page_id url html digest revisit_of refers``: of equal payloads of at least ``least_bytes`` bytes all but the
    smallest page_id revisit that one.  Pages whose payload cannot be repeated pass straight through, unshuffled."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html", _payload_key("html").alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    keys = materialize(rows.where(F.col("n") >= least_bytes).select("page_id", "digest", _place("url").alias("place")), "payloads")
    bitmap, n_cells = repeated_filter(keys.select("digest"), max(1, keys.count()), max_filter_bits)
    test = _maybe_repeated(spark, bitmap, n_cells)
    first = keys.where(test("digest")).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "place"))).alias("first"), F.count(F.lit(1)).alias("copies"))
    first = first.where("copies > 1 AND first IS NOT NULL").select(F.col("digest").alias("_d"), F.col("first.page_id").alias("_first"), F.col("first.place").alias("_place"))
    flagged = rows.withColumn("maybe", (F.col("n") >= least_bytes) & test("digest"))
    alone = flagged.where(~F.col("maybe")).select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("revisit_of"), F.lit(None).cast("string").alias("refers"))
    joined = flagged.where("maybe").join(first, F.col("digest") == F.col("_d"), "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    again = joined.select("page_id", "url", "html", "digest", F.when(other, F.col("_first")).alias("revisit_of"), F.when(other, F.col("_place")).alias("refers"))
    return alone.unionByName(again)


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` (``page_id url html``) as gzipped WARC files below ``path``.

    Null html is an empty payload, a null url an empty target; a null page_id is written without a number and never
    referred to.  Rows that share page_id, url and html become equal records and are all kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            html = batch.column(2)
            for i, (page, url, digest, first, refers) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True)):
                payload = (html[i].as_py() or "").encode("utf-8", "surrogatepass")
                for record in records(page, url, payload, digest, first, refers, segment_bytes):
                    out.append(record)
                    held += len(record)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = with_revisits(small_batches(pages)).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Content of one or more gzip members, or of a plain file, a piece at a time."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view = memoryview(data)
    while len(view):
        member = zlib.decompressobj(31)
        while not member.eof and len(view):
            part, view = view[:step], view[step:]
            yield member.decompress(part)
        rest = member.unused_data
        view = memoryview(rest + bytes(view)) if rest else view


def parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header fields, block) of the records of a WARC file, one at a time."""
    have, at, source = b"", 0, _inflated(data)

    def need(n: int) -> bool:
        """Have ``n`` bytes from ``at`` on, if the file has them; what lies before ``at`` is let go."""
        nonlocal have, at
        if len(have) - at >= n:
            return True
        parts, size = [have[at:]], len(have) - at
        while size < n and (piece := next(source, None)) is not None:
            parts.append(piece)
            size += len(piece)
        have, at = b"".join(parts), 0
        return size >= n

    while need(1):
        while (end := have.find(b"\r\n\r\n", at)) < 0:
            if not need(len(have) - at + 1):
                raise ValueError("WARC header is not closed")
        lines = have[at:end].split(b"\r\n")
        if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
            raise ValueError("not a WARC record")
        fields = _fields(lines[1:])
        head, size = end + 4 - at, int(fields[b"content-length"])
        if not need(head + size + 4) or have[at + head + size : at + head + size + 4] != b"\r\n\r\n":
            raise ValueError("WARC record is cut short")
        yield fields, have[at + head : at + head + size]
        at += head + size + 4


_OUT = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _page(urn: bytes | None) -> int | None:
    digits = urn.split(b":")[3] if urn else b""
    return int(digits) if digits else None


def _decoded(page: int | None, block: bytes, digest: bytes | None) -> tuple:
    payload, _ = http_payload(block)
    own = hashlib.sha256(payload).hexdigest()
    if digest and digest != b"sha256:" + own.encode():
        raise ValueError(f"payload of page {page} does not match its digest")
    return page, "response", None, own, len(payload), payload


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        names = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "origin", "number", "total", "block"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            rows, held = [], 0
            for fields, block in parse(batch.column(0)[i].as_py()):
                own, digest = fields[b"warc-record-id"].strip(b"<>"), fields.get(b"warc-payload-digest")
                if b"warc-segment-number" in fields:
                    origin = fields.get(b"warc-segment-origin-id", b"").strip(b"<>") or own
                    total = fields.get(b"warc-segment-total-length")
                    rows.append((_page(origin), None, None, digest and digest.decode(), None, None, origin.decode(), int(fields[b"warc-segment-number"]), total and int(total), block))
                elif fields[b"warc-type"] == b"revisit":
                    _, http = http_payload(block)
                    rows.append((_page(own), "revisit", _page(fields[b"warc-refers-to"].strip(b"<>")), digest.decode().partition(":")[2], int(http[b"content-length"]), None, None, None, None, None))
                elif fields[b"warc-type"] == b"response":
                    rows.append((*_decoded(_page(own), block, digest), None, None, None, None))
                held += len(block)
                if held > 1 << 24:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by origin and number: one page in memory at a time."""
    now, parts, total, copies, digest, page = None, [], None, 0, None, None

    def done() -> pa.RecordBatch:
        block = b"".join(parts)
        if total is None or len(block) != total:
            raise ValueError(f"segments of {now} make {len(block)} bytes, not {total}")
        row = _decoded(page, block, digest and digest.encode())
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v] * copies, k) for v, k in zip(row, kinds, strict=True)], ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

    for batch in batches:
        columns = [batch.column(k) for k in range(6)]
        for i in range(batch.num_rows):
            origin, number, whole, signed, its_page, block = (c[i].as_py() for c in columns)
            if origin != now:
                if now is not None:
                    yield done()
                now, parts, total, copies, digest, page = origin, [], None, 0, None, its_page
            if number == 1:
                copies, digest = copies + 1, signed  # equal records of repeated rows
            if number == len(parts) + 1:
                parts.append(block)
            elif number != len(parts) or block != parts[-1]:
                raise ValueError(f"segment {number} of {origin} is out of place")
            total = whole if whole is not None else total
    if now is not None:
        yield done()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id record_type refers_to payload_digest payload_bytes payload`` of every response and revisit below ``path``.

    ``payload`` is null for revisits; their size and digest come from their headers.  A wrong total length, a missing
    segment, broken chunk framing or a payload unlike its digest raises.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path).select("content")
    parsed = files.mapInArrow(_parse_files, f"{_OUT}, origin string, number int, total long, block binary")
    whole = parsed.where("origin IS NULL").select(*[x.split()[0] for x in _OUT.split(", ")])
    parts = parsed.where("origin IS NOT NULL").select("origin", "number", "total", "payload_digest", "page_id", "block")
    joined = parts.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(_reassemble, _OUT)
    return whole.unionByName(joined)


def op5_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to
FROM f
"""
