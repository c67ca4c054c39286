"""WARC records as a chunked record table.

A record is serialised as rows of at most ``chunk_bytes`` of payload each, numbered within the record: the first row begins
with the WARC and HTTP headers, the last ends with the record's trailer, and the rows of a record in order are its bytes in
a .warc file. Each row carries the SHA-1 of the payload up to and including it, so a reader can check a record as it
streams and knows which chunk is damaged. Payloads are cut in the JVM, a task's Python sees one chunk at a time, and no
side ever holds a serialised record. Reading back, a record of one chunk is checked where it lies; only the chunks of
oversized records are shuffled, by record and in order of their numbers.

Defined results: a null payload is empty; payloads are equal if their SHA-1 and length are; among equal payloads of at
least ``min_revisit_bytes`` the smallest page_id is the response (null ids come last) and rows that repeat that id are
responses too; the others are revisits, with headers only; a null url is an empty target; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.sources.staging import cut, table

from .common import base32_of_sha1, bounded_batches

CHUNK_BYTES = 64 << 10
CRLF = "\r\n"
#: No time of capture is known for these pages; a constant keeps archives reproducible.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record long, page_id long, chunk int, last boolean, digest string, data binary"


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of the records that are revisits; sha1 tells apart rows that share an id."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    narrow = cut(pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("sha1"), F.length(payload).alias("n")), "warc-digests")
    firsts = narrow.where(F.col("n") >= min_revisit_bytes).groupBy("sha1", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows"))
    # Staged, so that a hot digest's partition of the join can be split.
    firsts = cut(firsts.where("rows > 1").drop("rows"), "warc-firsts")
    return narrow.join(firsts, ["sha1", "n"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()


def chunk_table(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of CHUNKS for one record per row of pages."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x20]", "%20")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    revisits = cut(plan_records(pages, id_col, payload_col, min_revisit_bytes), "warc-revisits").select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha1"), "refers_to", F.lit(True).alias("revisit"))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left").withColumn("record", F.monotonically_increasing_id())
    n = F.length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n.cast("string"), F.lit(CRLF * 2))
    revisit = F.coalesce("revisit", F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn(F.col("page_id")), F.lit(":"), F.col("record").cast("string"),
        F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), base32_of_sha1(F.col("sha1")),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), urn(F.col("refers_to")), F.lit(">"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "),
        (F.length(http) + F.when(revisit, 0).otherwise(n)).cast("string"), F.lit(CRLF * 2), http,
    )
    chunks = F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(n / chunk_bytes))).cast("int")
    cutting = rows.select("record", "page_id", "payload", revisit.alias("revisit"), head.alias("head"), chunks.alias("chunks"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.substring(F.col("payload"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)))
    parts = cutting.select("record", "page_id", "chunk", (F.col("chunk") + 1 == F.col("chunks")).alias("last"), F.when(F.col("chunk") == 0, F.col("head")).cast("binary").alias("head"), body.alias("body"))
    return bounded_batches(parts).mapInArrow(_serialise, CHUNKS)


def _serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the running digest; the chunks of a record come in order, from one task."""
    running = hashlib.sha1(usedforsecurity=False)
    for b in batches:
        digests, data = [], []
        for k, last, head, body in zip(b.column(2), b.column(3), b.column(4), b.column(5), strict=True):
            if k.as_py() == 0:
                running = hashlib.sha1(usedforsecurity=False)
            part = body.as_py()
            running.update(part)
            digests.append(running.hexdigest())
            data.append((head.as_py() or b"") + part + (b"\r\n\r\n" if last.as_py() else b""))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(digests), pa.array(data, pa.binary())], ["record", "page_id", "chunk", "last", "digest", "data"])


class RecordReader:
    """Reads one record from its chunks, in order; keeps headers and a digest, never the payload."""

    def __init__(self) -> None:
        self.buffer, self.fields, self.http, self.left, self.seen = b"", None, None, 0, 0
        self.digest, self.intact = hashlib.sha1(usedforsecurity=False), True

    def feed(self, data: bytes, digest: str) -> None:
        if self.http is None:
            self.buffer += data
            if self.fields is None and b"\r\n\r\n" in self.buffer:
                head, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
                self.fields = _fields(head)
                self.left = int(self.fields["content-length"])
            if self.fields is not None and b"\r\n\r\n" in self.buffer:
                head, _, data = self.buffer.partition(b"\r\n\r\n")
                self.http, self.buffer = _fields(head), b""
                self.left -= len(head) + 4
            else:
                return
        part = data[: self.left]
        self.digest.update(part)
        self.seen += len(part)
        self.left -= len(part)
        self.buffer += data[len(part) :]
        self.intact &= self.digest.hexdigest() == digest

    def row(self) -> tuple:
        f, kind = self.fields, self.fields["warc-type"]
        said = f["warc-payload-digest"].removeprefix("sha1:")
        refers = re.match(r"<urn:page:(-?\d+)", f.get("warc-refers-to", ""))
        page = re.match(r"<urn:page:(-?\d+)", f["warc-record-id"])
        size = int(self.http["content-length"])
        own = base64.b32encode(self.digest.digest()).decode()
        intact = self.intact and self.left == 0 and self.buffer == b"\r\n\r\n" and (kind == "revisit" or (own, self.seen) == (said, size))
        return int(page[1]) if page else None, size, said if kind == "revisit" else own, kind, int(refers[1]) if refers else None, intact


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
    reader = RecordReader()
    for b in batches:
        found = []
        for k, last, digest, data in zip(b.column(2), b.column(3), b.column(4), b.column(5), strict=True):
            if k.as_py() == 0:
                reader = RecordReader()
            reader.feed(data.as_py(), digest.as_py())
            if last.as_py():
                found.append(reader.row())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record, as READ says; intact is false where a chunk, a length or the payload's digest is wrong."""
    whole = bounded_batches(chunks).where("chunk = 0 AND last")
    parts = chunks.where("NOT (chunk = 0 AND last)").repartition("record").sortWithinPartitions("record", "chunk")
    return whole.mapInArrow(_read, READ).unionByName(parts.mapInArrow(_read, READ))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(cut(chunk_table(table(spark, sf_dir, "pages")), "warc"))


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first_id,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), 'string_agg', '') AS b32 FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, true AS intact
FROM d
"""
