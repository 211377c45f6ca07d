"""WARC archives: segmented writing, reassembly and decoding (operator 3).

An archive is a folder of WARC 1.1 files that Spark writes and reads: a record is a row whose text ends in the two line
breaks that close every record, so any store Spark knows will do, and a lost task leaves nothing behind.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.llm.common import byte_values, written

VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP_OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 1000


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing. A chunk ends early inside anything that looks like the start of a record, so that the
    version line never occurs in a body."""
    cuts = sorted({*range(0, len(payload), size), *(m.start() + 4 for m in re.finditer(VERSION, payload)), len(payload)})
    parts = [b"%x\r\n%b\r\n" % (e - s, payload[s:e]) for s, e in zip(cuts, cuts[1:])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of chunked framing; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        if size == 0:
            return b"".join(parts)
        part = body[end + 2:end + 2 + size]
        if len(part) < size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            return None
        parts.append(part)
        at = end + 4 + size


def _record(fields: list[tuple[bytes, bytes | None]], block: bytes) -> bytes:
    head = b"".join(b"%b: %b\r\n" % (k, v) for k, v in fields if v is not None)
    return b"%b%bContent-Length: %d\r\n\r\n%b" % (VERSION, head, len(block), block)


def page_records(page_id: str | None, url: str | None, payload: bytes, digest: str, record_id: str, target: str | None,
                 date: str, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page without their closing line breaks: a revisit of ``target``, or a response that goes on in
    continuation records every ``segment_bytes`` bytes."""
    said = lambda x: None if x is None else re.sub(r"[\r\n]", " ", x).encode()
    name = lambda x: b"<%b>" % x.encode()
    common = [(b"WARC-Record-ID", name(record_id)), (b"WARC-Date", date.encode()), (b"WARC-Target-URI", said(url)),
              (b"WARC-Page-ID", said(page_id)),
              (b"WARC-Payload-Digest", b"sha1:" + base64.b32encode(bytes.fromhex(digest))),
              (b"Content-Type", b"application/http; msgtype=response")]
    if target is not None:
        return [_record([(b"WARC-Type", b"revisit"), (b"WARC-Profile", REVISIT_PROFILE), (b"WARC-Refers-To", name(target)),
                         *common], HTTP_OK + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = HTTP_OK + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = [block[s:s + segment_bytes] for s in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_record([(b"WARC-Type", b"response"), *common], block)]
    records = [_record([(b"WARC-Type", b"response"), *common, (b"WARC-Segment-Number", b"1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = k == len(parts)
        records.append(_record([
            (b"WARC-Type", b"continuation"), (b"WARC-Record-ID", name(f"{record_id}-{k}")), common[1], common[2],
            (b"WARC-Segment-Origin-ID", name(record_id)), (b"WARC-Segment-Number", b"%d" % k),
            (b"WARC-Segment-Total-Length", b"%d" % len(block) if last else None)], part))
    return records


def _record_id(page_id: F.Column, digest: F.Column) -> F.Column:
    key = F.sha1(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.substring(key, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})",
                                                         "$1-$2-$3-$4-$5"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   min_revisit: int = MIN_REVISIT, segment_bytes: int = 1 << 20, chunk_bytes: int = 8192,
                   date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row of ``pages`` to WARC files under ``path``.

    Of rows with equal payloads of ``min_revisit`` bytes or more, those with the largest id are responses and the others
    revisit them. A null payload is empty. Rows with a null id revisit a payload that has an id; rows that repeat the
    largest id of a payload all stay responses. Payloads do not leave their task unless the table of repeated payloads
    is above Spark's limit for broadcasts; that table has a row per payload, whatever the number of its copies.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"),
                        F.sha1(body).alias("digest"))
    again = (rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
             .agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL")
             .select("digest", "keeper"))
    long_enough = F.octet_length("payload") >= min_revisit
    # as a written table its size is known before the join is planned
    marked = rows.join(written(again, "repeated"), "digest", "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest", _record_id(F.col("id"), F.col("digest")).alias("record_id"),
        F.when(long_enough & F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")),
               _record_id(F.col("keeper"), F.col("digest"))).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            records = [r for page in zip(*columns)
                       for r in page_records(*page, date, segment_bytes, chunk_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    records = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", END).text(path)


FIELDS = {"type": b"warc-type", "record_id": b"warc-record-id", "page_id": b"warc-page-id", "url": b"warc-target-uri",
          "refers_to": b"warc-refers-to", "origin_id": b"warc-segment-origin-id", "segment": b"warc-segment-number",
          "total": b"warc-segment-total-length", "digest": b"warc-payload-digest"}


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    pairs = (line.partition(b":") for line in lines if b":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _parsed(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Records from what stands between version lines. A piece that is shorter than its Content-Length has been cut at
    a version line in its block and is joined with the next."""
    held = b""
    for piece in pieces:
        piece = held + VERSION + piece if held else piece
        held = b""
        head, found, rest = piece.partition(b"\r\n\r\n")
        fields = _fields(head)
        if not found or b"warc-type" not in fields:
            continue
        length = int(fields.get(b"content-length", b"0"))
        if len(rest) < length:
            held = piece
            continue
        values = [fields.get(f) for f in FIELDS.values()]
        yield *(None if v is None else v.decode("utf-8", "replace").strip("<>") for v in values), rest[:length]


def _scan(spark: SparkSession, path: str) -> DataFrame:
    names = [*FIELDS, "block"]
    size = 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [pa.string()] * len(FIELDS) + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        rows: list[tuple] = []
        for row in _parsed(x for b in batches for x in byte_values(b.column(0))):
            rows.append(row)
            if len(rows) == size:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    lines = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(run, ", ".join(f"{n} string" for n in FIELDS) + ", block binary").withColumns(
        {"segment": F.col("segment").cast("int"), "total": F.col("total").cast("long")})


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    """The segments of one origin in order of their numbers as one block, ``whole`` if none is missing and the lengths
    add up to the total. Records written twice come back twice."""
    parts = parts.sort_values("segment", kind="stable")
    first = parts[parts["segment"] == 1]
    once = parts.drop_duplicates("segment")
    block = b"".join(once["block"])
    total = once["total"].dropna()
    whole = list(once["segment"]) == list(range(1, len(once) + 1)) and len(total) == 1 and int(total.iloc[0]) == len(block)
    copies = first if len(first) else once.head(1)
    return copies[["type", "record_id", "page_id", "url", "refers_to", "digest"]].assign(block=block, whole=whole)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives with its payload: type, record_id, page_id, url, refers_to, declared (its payload
    digest as the header has it), payload (null for revisits and broken framing) and ``whole``.

    Records in several segments are grouped by their origin, put in order, checked against their total length and only
    then freed of the chunked framing. A record with missing segments or a wrong total has ``whole`` false. Archives
    of other writers whose blocks hold a version line are read rightly too, unless a split of the file falls just there;
    such a record is left out.
    """
    scan = _scan(spark, path)
    keep = ["type", "record_id", "page_id", "url", "refers_to", "digest", "block"]
    alone = scan.where("segment IS NULL").select(*keep, F.lit(True).alias("whole"))
    kinds = "type string, record_id string, page_id string, url string, refers_to string, digest string, block binary, whole boolean"
    joined = (scan.where("segment IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
              .groupBy("origin").applyInPandas(_joined, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for kind, block in zip(batch.column(0).to_pylist(), byte_values(batch.column(6))):
                head, _, body = block.partition(b"\r\n\r\n")
                framed = b"chunked" in _fields(head).get(b"transfer-encoding", b"").lower()
                payloads.append(None if kind == "revisit" else dechunked(body) if framed else body)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], batch.column(5), pa.array(payloads, pa.binary()), batch.column(7)],
                                             ["type", "record_id", "page_id", "url", "refers_to", "declared", "payload", "whole"])

    return alone.union(joined).mapInArrow(run, "type string, record_id string, page_id string, url string, refers_to string, "
                                               "declared string, payload binary, whole boolean")


def resolved(records: DataFrame) -> DataFrame:
    """Records (type, record_id, page_id, refers_to, payload_bytes, payload_digest) in which every revisit has the size,
    digest and page of the response it refers to; null where that is not in the archives."""
    target = (records.where("type = 'response'").groupBy(F.col("record_id").alias("_id"))
              .agg(F.first("payload_bytes").alias("_bytes"), F.first("payload_digest").alias("_digest"),
                   F.first("page_id").alias("_page")))
    joined = records.join(target, (F.col("type") == "revisit") & (F.col("refers_to") == F.col("_id")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
                         F.coalesce("payload_digest", "_digest").alias("payload_digest"),
                         F.col("type").alias("record_type"), F.col("_page").alias("refers_to"))
