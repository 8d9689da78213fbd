"""WARC archives: writing with segmented records, reading back, reassembly.

A payload is framed as an HTTP response with chunked transfer coding. A block longer
than a segment is cut: the first record holds segment 1, continuation records name the
first one's identifier, and the last one states the total length. Of records with equal
payloads the one with the smallest page id is stored and the others are revisits that
name its payload digest.

Archives are written with Spark's text sink, whose line separator is the two empty
lines that end a record: any store works, and its commit protocol survives lost tasks.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import scratch_path

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
# Records per archive file: readers take a file as a whole.
RECORDS_PER_FILE = 4_000
_END = "\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RECORD = (
    "record_id string, origin_id string, segment int, total long, type string, page_id long, "
    "digest string, block binary, error string"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bytes are four groups of eight digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _http(payload: bytes, chunk: int) -> bytes:
    """An HTTP response whose body is the payload in chunks."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    parts = [payload[i : i + chunk] for i in range(0, len(payload), chunk)]
    return head + b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def decode_http(block: bytes) -> bytes:
    """The payload of an HTTP response; a body without chunked coding is the payload.

    Raises ValueError for a body that is cut short or not framed as it says.
    """
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no_http_header")
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head):
        return body
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        size_text = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size_text):
            raise ValueError("bad_chunk")
        size, at = int(size_text, 16), end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("bad_chunk")
        parts.append(body[at : at + size])
        at += size + 2


def _clean(url: str | None) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None and v != ""]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block


def _records(row: dict, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """All records of one page: one, or a first segment and its continuations."""
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", _clean(row["url"])), ("Page-Id", row["page_id"])]
    name = f"<urn:uuid:{row['uid']}>"
    digest = ("WARC-Payload-Digest", f"sha1:{row['digest']}")
    kind = ("Content-Type", "application/http;msgtype=response")
    if row["revisit"]:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, digest]
        yield _record([*fields, ("WARC-Profile", profile)], b"")
        return
    block = _http(row["payload"], chunk_bytes)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, digest, kind]
    if len(pieces) > 1:
        first.append(("WARC-Segment-Number", 1))
    yield _record(first, pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        last = n == len(pieces)
        tail = hashlib.md5(f"{row['uid']}/{n}".encode()).hexdigest()
        own = f"<urn:uuid:{tail[:8]}-{tail[8:12]}-{tail[12:16]}-{tail[16:20]}-{tail[20:]}>"
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), *common]
        fields += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n)]
        yield _record([*fields, ("WARC-Segment-Total-Length", len(block) if last else None)], piece)


def write_warc(
    pages: DataFrame,
    path: str,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write ``page_id, url, html`` as gzip-compressed archives, one record per row or more.

    A null html is an empty payload. Rows that hold both the smallest page id and the
    payload are all responses, so rows that repeat stay whole; a null page id is
    larger than any other.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    known = F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1))
    copied = (
        rows.groupBy("digest")
        .agg(F.min(known).alias("first_id"), F.max(known).alias("last_id"))
        .filter("first_id < last_id")
        .drop("last_id")
    )
    marked = rows.join(copied, "digest", "left").select(
        "page_id",
        "url",
        "digest",
        F.uuid().alias("uid"),
        F.coalesce(known > F.col("first_id"), F.lit(False)).alias("revisit"),
        F.when(known > F.col("first_id"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = list(_records(row, segment_bytes, chunk_bytes))
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    records = marked.mapInArrow(render, "value binary").select(F.col("value").cast("string"))
    writer = records.write.option("lineSep", _END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def _inflate(data: bytes) -> tuple[bytes, bool]:
    """The content of a gzip file, member by member, and whether it breaks off or is damaged."""
    parts = []
    while data:
        member = zlib.decompressobj(wbits=31)
        try:
            parts.append(member.decompress(data))
        except zlib.error:
            return b"".join(parts), True
        if not member.eof:
            return b"".join(parts), True
        data = member.unused_data.lstrip(b"\0")
    return b"".join(parts), False


def _number(text: str | None, bits: int) -> int | None:
    """A whole number that fits; anything else is a ValueError, an absent one is None."""
    if text is None or text == "":
        return None
    value = int(text)
    if not -(1 << bits - 1) <= value < 1 << bits - 1:
        raise ValueError(text)
    return value


def _nothing(error: str) -> tuple:
    return (None,) * 8 + (error,)


def _parse(data: bytes) -> Iterator[tuple]:
    """Records of one archive, found by their stated lengths.

    A record without a length ends the archive as ``bad_record``; one whose numbers are
    none is a ``bad_record`` and reading goes on behind it. A file that breaks off gives
    what can be read of it and a ``truncated`` record.
    """
    broken = False
    if data[:2] == b"\x1f\x8b":
        data, broken = _inflate(data)
    at = 0
    while at < len(data):
        gap = data.find(b"\r\n\r\n", at)
        lines = data[at:gap].decode("utf-8", "replace").split("\r\n") if gap >= 0 else [""]
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = named.get("content-length", "")
        if not lines[0].startswith("WARC/") or not (size.isascii() and size.isdigit()):
            yield _nothing("truncated" if broken else "bad_record")
            return
        block = data[gap + 4 : gap + 4 + int(size)]
        at = gap + 4 + int(size) + 4
        try:
            segment = _number(named.get("warc-segment-number"), 32)
            total = _number(named.get("warc-segment-total-length"), 64)
            page = _number(named.get("page-id"), 64)
        except ValueError:
            yield _nothing("bad_record")
            continue
        own = named.get("warc-record-id")
        whole = len(block) == int(size)
        broken &= whole
        yield (
            own,
            named.get("warc-segment-origin-id", own),
            segment,
            total,
            named.get("warc-type"),
            page,
            named.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            block,
            None if whole else "truncated",
        )
    if broken:
        yield _nothing("truncated")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below a path, segments still apart."""
    names = [part.split()[0] for part in _RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
    kinds += [pa.string(), pa.binary(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for row in _parse(content.as_py()):
                    rows.append(row)
                    if len(rows) == 200:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(read, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response: ``page_id, digest, block, error``, continuations joined.

    Only records with a segment number are shuffled, by their origin's identifier. A
    group is one payload's segments. ``missing_segment`` and ``wrong_length`` mark
    responses that cannot be put together; a segment that is there twice counts once.
    """
    whole = records.filter("type = 'response' AND segment IS NULL").select(
        "page_id", "digest", "block", "error"
    )
    parts = records.filter("segment IS NOT NULL")
    grouped = parts.groupBy("origin_id").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("page_id", "digest"))).alias("first"),
        F.max("total").alias("total"),
        F.max("error").alias("error"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
    )
    numbers = F.transform("parts", lambda p: p.segment)
    joined = grouped.select(
        F.col("first.page_id").alias("page_id"),
        F.col("first.digest").alias("digest"),
        F.array_join(F.transform("parts", lambda p: p.block.cast("string")), "").cast("binary").alias("block"),
        "total",
        "error",
        (numbers == F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1)))).alias("gapless"),
    )
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("gapless") | F.col("total").isNull(), "missing_segment")
        .when(F.octet_length("block") != F.col("total"), "wrong_length")
    )
    fixed = joined.withColumn("error", error).select("page_id", "digest", "block", "error")
    return whole.unionByName(fixed)


def decode_payloads(responses: DataFrame) -> DataFrame:
    """Add the decoded ``payload``; a block that does not decode has an error instead."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, errors = [], []
            for block, error in zip(
                batch.column("block").to_pylist(), batch.column("error").to_pylist(), strict=True
            ):
                payload = None
                if error is None:
                    try:
                        payload = decode_http(block)
                    except ValueError as e:
                        error = str(e)
                payloads.append(payload)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("digest"),
                    pa.array(payloads, pa.binary()),
                    pa.array(errors, pa.string()),
                ],
                names=["page_id", "digest", "payload", "error"],
            )

    schema = "page_id long, digest string, payload binary, error string"
    return responses.select("page_id", "digest", "block", "error").mapInArrow(decode, schema)


def page_digests(records: DataFrame) -> DataFrame:
    """Per page what the archives hold: size and digest of the full payload, type, origin.

    Sizes and digests are taken from the payloads that were put together and decoded.
    A revisit finds its response by the payload digest.
    """
    responses = decode_payloads(reassemble(records)).select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    stored = responses.groupBy("payload_digest").agg(
        F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes")
    )
    revisits = (
        records.filter("type = 'revisit'")
        .select("page_id", F.col("digest").alias("payload_digest"))
        .join(stored, "payload_digest", "left")
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = responses.withColumns(
        {"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}
    )
    return own.select(columns).unionByName(
        revisits.withColumn("record_type", F.lit("revisit")).select(columns)
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back, digest them."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    return page_digests(read_records(spark, path))
