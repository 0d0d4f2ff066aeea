"""WARC archives: writing pages as records, and reading them back with segment reassembly and chunked-transfer decoding.

Writing is expressions only: Spark's text writer stores a record per row, and its line separator is the blank line that ends a
WARC record.  Reading parses one archive file at a time as a stream; records that were cut into segments are put together
again by a group-by on the identifier of their first segment.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved

#: Payloads from this size on are compared; equal ones are stored once.
REVISIT_BYTES = 100
#: A longer block is cut into segments; a chunk of the transfer framing; records per archive file.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 64 << 10, 8 << 10, 2_000
#: Rows go back to Spark when so many bytes are parsed.
FLUSH_BYTES = 8 << 20
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "record_id string, warc_type string, target_uri string, payload_digest string, refers_to string, origin_id string, segment_number int, total_length bigint, block binary"


def _chunked(payload: Column, n: Column) -> Column:
    """The payload in chunked transfer framing, as the bytes of a string."""
    def chunk(i):
        length = F.least(n - i * CHUNK_BYTES, F.lit(CHUNK_BYTES))
        data = F.substring(payload, (i * CHUNK_BYTES + 1).cast("int"), F.lit(CHUNK_BYTES)).cast("string")
        return F.concat(F.lower(F.hex(length.cast("bigint"))), F.lit("\r\n"), data, F.lit("\r\n"))

    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), ((n - 1) / CHUNK_BYTES).cast("int")), chunk)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(chunks, ""), F.lit("0\r\n\r\n"))


def _line(name: str, value: Column) -> Column:
    """A header line, empty if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def to_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row `record` (header and block, without the closing blank line) per WARC record of the pages (page_id, url, html).

    Of the pages with equal payloads of REVISIT_BYTES or more that with the smallest page_id becomes a response, the others
    revisit it.  Rows that tie on it are all responses.  Null html: an empty payload.  Null page_id: never the smallest.  Null
    url: no target header; line breaks in a url are dropped.  Record ids carry the page id and the row's place.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    first = rows.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    first = saved(first.filter("copies > 1").select(F.col("digest").alias("d"), "first"))
    rows = rows.join(first, rows["digest"] == first["d"], "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    rows = rows.withColumn("id", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.monotonically_increasing_id().cast("string")))
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.concat(F.lit(HTTP_HEAD), _chunked(F.col("payload"), F.col("n"))))
    # the generator keeps the block from being built once per use
    rows = rows.select("id", "url", "digest", "revisit", "first", F.explode(F.array(block)).alias("block")).withColumn("total", F.octet_length("block"))
    n_segments = F.greatest(F.lit(1), F.ceil(F.col("total") / segment_bytes)).cast("int")
    cut = rows.withColumn("n_segments", n_segments).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_segments"))))
    part = F.substring(F.col("block").cast("binary"), ((F.col("k") - 1) * segment_bytes + 1).cast("int"), F.lit(segment_bytes))
    bracket = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    is_first, segmented = F.col("k") == 1, F.col("n_segments") > 1
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(~is_first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", bracket(F.when(is_first, F.col("id")).otherwise(F.concat("id", F.lit(":"), F.col("k").cast("string"))))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.when(is_first, F.concat(F.lit("sha256:"), "digest"))),
        _line("WARC-Profile", F.when(F.col("revisit"), REVISIT_PROFILE)),
        _line("WARC-Refers-To", F.when(F.col("revisit"), bracket(F.concat(F.lit("urn:page:"), F.col("first").cast("string"))))),
        _line("WARC-Segment-Origin-ID", F.when(~is_first, bracket(F.col("id")))),
        _line("WARC-Segment-Number", F.when(segmented, F.col("k").cast("string"))),
        _line("WARC-Segment-Total-Length", F.when(segmented & (F.col("k") == F.col("n_segments")), F.col("total").cast("string"))),
        _line("Content-Type", F.when(is_first, "application/http;msgtype=response")),
        _line("Content-Length", F.octet_length("part").cast("string")),
        F.lit("\r\n"),
    )
    return cut.withColumn("part", part.cast("string")).select(F.concat(header, "part").alias("record"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Gzipped archives below `path`, one or more per task; a file holds FILE_RECORDS records of bounded size at most."""
    writer = to_records(pages, **options).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS)
    writer.text(path)


def parse(stream, name: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record of a stream; raises ValueError where the archive is broken."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError(f"{name}: cut off within a header")
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        if not headers.get("content-length", "").isdecimal():
            raise ValueError(f"{name}: {headers.get('warc-record-id')} has no length")
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"{name}: {headers.get('warc-record-id')} has {len(block)} of {length} bytes")
        yield headers, block


def decode_http(block: bytes) -> bytes:
    """The payload of an HTTP response: what follows its header, without chunked transfer framing."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("no end of the HTTP header")
    coded = any(h.partition(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in h.lower() for h in head.split(b"\r\n")[1:])
    if not coded:
        return body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_RECORDS = pa.schema([
    ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
    ("origin_id", pa.string()), ("segment_number", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary()),
])


def read_records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """The records below `path`, those in segments or the others; a file is decompressed and parsed as a stream."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                raw = io.BytesIO(data)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
                rows, size = [], 0
                for h, block in parse(stream, name):
                    if ("warc-segment-number" in h) != segmented:
                        continue
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    rows.append((
                        _bare(h.get("warc-record-id")), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest"), _bare(h.get("warc-refers-to")),
                        _bare(h.get("warc-segment-origin-id")), int(number) if number else None, int(total) if total else None, block,
                    ))
                    size += len(block) + 500
                    if size > FLUSH_BYTES:
                        yield _arrow(rows, _RECORDS)
                        rows, size = [], 0
                yield _arrow(rows, _RECORDS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def reassemble(segments: DataFrame) -> DataFrame:
    """Segments to whole records: record_id, target_uri, payload_digest, block, complete.

    Grouped by the identifier of the first segment and ordered by number.  A record is complete if its numbers run from 1
    without gap or repetition and the joined length is that which the last segment states; the block of an incomplete one is
    what is there.
    """
    key = F.coalesce("origin_id", "record_id")
    parts = F.sort_array(F.collect_list(F.struct("segment_number", F.col("block").cast("string").alias("b"))))
    whole = segments.groupBy(key.alias("record_id")).agg(
        parts.alias("parts"), F.max("total_length").alias("total"),
        F.max(F.when(F.col("segment_number") == 1, F.col("target_uri"))).alias("target_uri"),
        F.max(F.when(F.col("segment_number") == 1, F.col("payload_digest"))).alias("payload_digest"),
    )
    block = F.array_join(F.transform("parts", lambda p: p["b"]), "")
    whole = whole.withColumn("joined", F.explode(F.array(block)))
    in_order = F.transform("parts", lambda p: p["segment_number"]) == F.sequence(F.lit(1), F.size("parts"))
    complete = F.coalesce(in_order & (F.octet_length("joined") == F.col("total")), F.lit(False))
    return whole.select("record_id", "target_uri", "payload_digest", F.col("joined").cast("binary").alias("block"), complete.alias("complete"))


def payloads(records: DataFrame) -> DataFrame:
    """`records` (with a column block) with `payload`, the decoded HTTP body, in place of the block; null for an empty block."""
    names = [c for c in records.columns if c not in ("block", "payload")]

    def run(batches):
        for b in batches:
            decoded = [decode_http(x) if x else None for x in b.column("block").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(decoded, pa.binary())], names=[*names, "payload"])

    rows = records.select(*names, "block")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "block") + ", payload binary"
    return rows.mapInArrow(run, schema)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What archives hold per page: page_id, url, record_type, refers_to, payload_digest (as computed), payload_bytes.

    A revisit takes length and digest from the response that it names (page and digest).  An incomplete segmented record or a
    digest that differs from the stated one raises an error.
    """
    page = lambda c: F.expr(f"nullif(split_part({c}, ':', 3), 'null')").cast("bigint")
    plain = payloads(read_records(spark, path, False).select("record_id", "warc_type", "target_uri", "payload_digest", "refers_to", "block"))
    pieces = payloads(reassemble(read_records(spark, path, True)).withColumn("block", F.when(F.col("complete"), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("incomplete: "), "record_id")).cast("binary"))))
    pieces = pieces.select("record_id", F.lit("response").alias("warc_type"), "target_uri", "payload_digest", F.lit(None).cast("string").alias("refers_to"), "payload")
    stated = F.substring_index("payload_digest", ":", -1)
    digest = F.sha2("payload", 256)
    checked = F.when(F.col("payload").isNull() | stated.isNull() | (stated == digest), F.coalesce(digest, stated)).otherwise(F.raise_error(F.concat(F.lit("wrong digest: "), "record_id")))
    narrow = saved(
        plain.unionByName(pieces).select(
            page("record_id").alias("page_id"), F.col("target_uri").alias("url"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"),
            checked.alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        )
    )
    held = narrow.filter("record_type = 'response'").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).distinct()
    revisits = narrow.filter("record_type = 'revisit'").drop("payload_bytes")
    revisits = revisits.join(held, (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("d")), "left").withColumnRenamed("b", "payload_bytes")
    return narrow.filter("record_type <> 'revisit'").unionByName(revisits.select(*narrow.columns))
