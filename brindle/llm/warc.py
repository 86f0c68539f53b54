"""WARC archives: pages to records and back, with segment reassembly.

Writing: a page's payload is framed as a chunked HTTP response; of records with equal payloads one is the response and
the others revisit it. A block of more than ``segment_bytes`` is split: the record itself is segment 1, continuation
records with the origin's identifier follow, the last of which tells the total length.

Reading: each file is parsed record by record; segments are grouped by origin identifier, ordered by number and joined
if no number is missing and the length is the total that was told. Then the HTTP head is taken off, the chunked framing
decoded and the payload's digest compared.

Files are written and read by Spark's own sources (a record is a line of the text writer, with its last line feed as
the separator; the reader is binaryFile), so that any file system that Spark knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

#: Fixed by the format.
VERSION, CRLF = b"WARC/1.1", b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; ValueError if that is broken. Extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(parts)
        at = end + 2
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(CRLF + CRLF)
    fields = [line.split(b":", 1) for line in head.split(CRLF)[1:] if b":" in line]
    coded = any(k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower() for k, v in fields)
    return dechunked(body) if coded else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION] + [f"{k}: {v}".encode() for k, v in fields] + [b"Content-Length: %d" % len(block), b"", b""]
    return CRLF.join(head) + block + CRLF + CRLF


def _one_line(value: str) -> str:
    return " ".join(value.split())


def records_of(page: int | None, url: str | None, payload: bytes, sha1: bytes, target: int | None, copy: int, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    digest = base32(sha1)
    name = lambda x: f"urn:x-page:{'' if x is None else x}:{digest}"
    common = [("WARC-Date", _DATE)] + ([("WARC-Target-URI", _one_line(url))] if url else [])
    own = f"<{name(page)}#{copy}>"
    if target is not None and target != page:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{name(target)}>"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
        return [record(fields, _HTTP)]
    block = _HTTP + chunked(payload, chunk_bytes)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        return [record(fields, block)]
    out = [record([*fields, ("WARC-Segment-Number", "1")], block[:segment_bytes])]
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name(page)}#{copy}.{number}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number))]
        if at + segment_bytes >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(more, block[at : at + segment_bytes]))
    return out


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, segment_bytes: int = 32 << 10, chunk_bytes: int = 8 << 10, records_per_file: int = 4000) -> None:
    """Write a record for each page to gzipped files in the folder ``path``.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, that with the largest id is the response;
    repeated rows of that id all are. A null html is an empty payload. A null id is smaller than any other: such a page
    revisits one with an id, or is a response where none has. A null url has no header. Extra columns are left out.

    Digests find the response of each payload in narrow rows, pre-aggregated in each task, so a payload that a third of
    the pages share is no hot group; whole pages are shuffled once, by id.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha1"))
    last = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha1").agg(F.max("id").alias("target"))
    named = rows.select("id", "sha1").distinct().join(last, "sha1", "left").select(F.col("id").alias("n_id"), F.col("sha1").alias("n_sha1"), "target")
    whole = rows.join(named, F.col("id").eqNullSafe(F.col("n_id")) & (F.col("sha1") == F.col("n_sha1")), "left").select("id", "url", "payload", "sha1", "target", F.monotonically_increasing_id().alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for i in range(batch.num_rows):
                # The text writer adds the last line feed.
                new = [x[:-1] for x in records_of(*(c[i].as_py() for c in batch.columns), segment_bytes, chunk_bytes)]
                out += new
                size += sum(map(len, new))
                if size > 2 << 20:  # some megabytes at a time, not the records of a whole batch
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = whole.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(content: bytes, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a file, gzipped (as a whole or by records) or not."""

    def plain() -> Iterator[bytes]:
        if content[:2] != b"\x1f\x8b":
            yield content
            return
        at, rest = 0, b""
        member = zlib.decompressobj(31)
        while at < len(content) or rest:
            data = rest or content[at : at + piece]
            at += 0 if rest else piece
            yield member.decompress(data)
            rest = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)

    source, held = plain(), bytearray()

    def more() -> bool:
        for data in source:
            if data:
                held.extend(data)
                return True
        return False

    while True:
        while held[:2] == CRLF:  # between records
            del held[:2]
        while (end := held.find(CRLF + CRLF)) < 0:
            if not more():
                if held.strip():
                    raise ValueError("record is cut short")
                return
            while held[:2] == CRLF:
                del held[:2]
        head = bytes(held[:end]).split(CRLF)
        if not head[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {head[0][:40]!r}")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, v in (x.split(b":", 1) for x in head[1:])}
        size = int(fields["content-length"])
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError("block is cut short")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


_RECORDS = "record_id string, type string, uri string, origin string, segment int, total bigint, digest string, refers string, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the files in a folder; the file size is bounded by the writer (and by Spark, at 2 GB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.strip().split(" ") for x in _RECORDS.split(","))])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parse_records(content.as_py()):
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    rows.append((f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f.get("warc-segment-origin-id"), number and int(number), total and int(total), f.get("warc-payload-digest"), f.get("warc-refers-to"), block))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: (record_id, type, uri, digest, refers, block, complete).

    Records without a segment number pass by. The others are grouped by origin identifier (that of segment 1 is its
    own), ordered by number and joined; complete is false, and the block null, where a number is missing or comes
    twice, no total length is told or the sum of lengths differs from it. A group is the segments of one record.
    """
    whole = records.where(F.col("segment").isNull()).select("record_id", "type", "uri", "digest", "refers", "block", F.lit(True).alias("complete"))
    parts = records.where(F.col("segment").isNotNull()).withColumn("of", F.coalesce("origin", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = parts.groupBy(F.col("of").alias("record_id")).agg(first("type"), first("uri"), first("digest"), first("refers"), F.max("total").alias("total"), F.sum(F.octet_length("block")).alias("size"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    numbers = F.transform("parts", lambda p: p["segment"])
    complete = F.coalesce((numbers == F.sequence(F.lit(1), F.size("parts"))) & (F.col("total") == F.col("size")), F.lit(False))
    block = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    return whole.unionByName(joined.select("record_id", "type", "uri", "digest", "refers", F.when(complete, block).alias("block"), complete.alias("complete")))


_PAGES = "page_id bigint, uri string, type string, name string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, refers_name string, error string"


def read_pages(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """page_id, uri, type, payload (null for revisits), payload_bytes, payload_digest, refers_to and error.

    error tells what is wrong with a record (incomplete, broken framing, other digest) and is null otherwise. A
    revisit's payload_bytes is that of the response it refers to, null if that isn't there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                name = r["record_id"].strip("<>").split("#")[0]
                page = lambda x: int(x.split(":")[2]) if x and x.split(":")[2] else None
                other = r["refers"].strip("<>") if r["refers"] else None
                told = (r["digest"] or "").removeprefix("sha1:") or None
                payload = size = error = None
                if not r["complete"]:
                    error = "incomplete"
                elif r["type"] == "response":
                    try:
                        payload = http_payload(r["block"])
                    except ValueError as x:
                        error = f"framing: {x}"
                    else:
                        size, digest = len(payload), base32(hashlib.sha1(payload).digest())
                        error = "digest differs" if told not in (None, digest) else None
                        told = digest
                rows.append((page(name), r["uri"], r["type"], name, payload if with_payload else None, size, told, page(other) if r["type"] == "revisit" else None, other, error))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            names = [x.strip().split(" ")[0] for x in _PAGES.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    found = reassemble(read_records(spark, path)).mapInArrow(run, _PAGES)
    sizes = found.where(F.col("type") == "response").groupBy(F.col("name").alias("refers_name")).agg(F.max("payload_bytes").alias("there"))
    return found.join(sizes, "refers_name", "left").select("page_id", "uri", "type", "payload", F.coalesce("payload_bytes", "there").alias("payload_bytes"), "payload_digest", "refers_to", "error")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    out = read_pages(spark, path, with_payload=False)
    failed = F.raise_error(F.concat(F.lit("record can't be read back: "), F.col("error"))).cast("string")
    return out.select("page_id", "payload_bytes", "payload_digest", F.when(F.col("error").isNull(), F.col("type")).otherwise(failed).alias("record_type"), "refers_to")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, html, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // 32768) % 32, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // 1024) % 32, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // 32) % 32, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v % 32, 1)
           for v in [CAST('0x' || substr(h, 1 + 5 * i, 5) AS BIGINT) for i in range(0, 8)]], 'string_agg', '') AS digest FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY digest)
"""
