"""WARC archives with revisit records, written and read by Spark jobs.

Writing: headers are grouped by payload digest (combined before the shuffle), the original of each
digest is joined back, and every record is written with fresh headers: the original as ``response``
with its payload, the others as ``revisit`` with HTTP headers only and a reference to the original.
Reading: a record is found by its declared length, so payloads may hold any line breaks; revisits are
joined to their originals on digest and record id.

Files are Spark text files whose line separator is the blank line that ends a record, compressed as
gzip; a compressed file is read by one task in its order, one record in memory at a time.

Defined results:

- null html: an empty payload; null url: no target header, read back as null; line breaks in a url are
  percent-encoded; null page_id: no id header, null again, and smaller than any other id;
- of equal payloads the largest page_id is the response; of rows that tie in it, one (equal rows are
  interchangeable); payloads under ``least_bytes`` are all responses;
- an empty table writes an archive without records, which reads as no rows;
- other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.llm.common import text_batches
from cobaltmill.session import fresh_path, materialise, table

CRLF = "\r\n"
END = CRLF + CRLF
LEAST_BYTES = 0
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = ("page_id long, record_id string, record_type string, url string, payload_digest string, "
           "payload_bytes long, refers_to_record string, payload string, intact boolean")


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes, in groups of 20 bits."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _urn(seed: Column) -> Column:
    d = F.md5(seed)
    cut = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line; empty if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html)."""
    seed = uuid.uuid4().hex
    payload = F.coalesce(F.col("html"), F.lit(""))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    staged = materialise(pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"),
        base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row")), "warc-staged", "zstd")
    firsts = materialise(
        staged.filter(F.col("bytes") >= least_bytes).groupBy("digest")
        .agg(F.max(F.struct("page_id", "row", "url")).alias("first")), "warc-firsts")
    joined = staged.join(firsts, "digest", "left")
    again = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
                    _header("Content-Length", F.col("bytes")), F.lit(CRLF))
    block = F.when(again, F.octet_length("http")).otherwise(F.octet_length("http") + F.col("bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _urn(F.concat(F.lit(seed), F.col("row").cast("string")))),
        _header("WARC-Date", now),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Page-ID", F.col("page_id")),
        _header("WARC-Profile", F.when(again, PROFILE)),
        _header("WARC-Refers-To",
                F.when(again, _urn(F.concat(F.lit(seed), F.col("first.row").cast("string"))))),
        _header("WARC-Refers-To-Target-URI", F.when(again, F.col("first.url"))),
        _header("WARC-Refers-To-Date", F.when(again, now)),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _header("Content-Length", block), F.lit(CRLF))
    body = F.when(again, F.col("http")).otherwise(F.concat("http", "payload"))
    records = joined.withColumn("http", http).select(F.concat(head, body).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split(CRLF)[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line)


class _Stream:
    """Cuts the bytes of one file into records."""

    def __init__(self, with_payload: bool):
        self.held, self.with_payload = bytearray(), with_payload
        self.need = 0

    def feed(self, chunk: str) -> Iterator[tuple]:
        self.held += chunk.encode("utf-8", "surrogatepass")
        self.held += END.encode()
        while len(self.held) >= max(self.need, 1):
            stop = self.held.find(END.encode())
            if stop < 0:
                return
            head = _fields(bytes(self.held[:stop]))
            if "Content-Length" not in head:  # line breaks after the last record
                del self.held[:stop + 4]
                continue
            start = stop + 4
            self.need = start + int(head["Content-Length"]) + 4
            if len(self.held) < self.need:
                return
            block = bytes(self.held[start:self.need - 4])
            del self.held[:self.need]
            self.need = 0
            yield self.record(head, block)

    def record(self, head: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(END.encode())
        length = int(_fields(http)["Content-Length"])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        intact = None
        if head["WARC-Type"] == "response":
            intact = len(payload) == length and base64.b32encode(
                hashlib.sha1(payload).digest()).decode() == digest
        page = head.get("WARC-Page-ID")
        return (None if page is None else int(page), head["WARC-Record-ID"], head["WARC-Type"],
                head.get("WARC-Target-URI"), digest, length, head.get("WARC-Refers-To"),
                payload.decode("utf-8") if self.with_payload and intact is not None else None, intact)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive; ``intact`` tells if a response's payload has its digest and length.

    Without ``payload`` that column is null, which saves sending the payloads back from the workers.
    """
    chunks = text_batches(spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("file"), "value"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, file = _Stream(payload), None
        schema = pa.schema([
            ("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
            ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
            ("refers_to_record", pa.string()), ("payload", pa.string()), ("intact", pa.bool_())])
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != file:
                    stream, file = _Stream(payload), name
                rows += stream.feed(value.as_py())
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return chunks.mapInArrow(run, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the page id of the response that a revisit refers to."""
    records = materialise(records, "warc-records")
    originals = records.filter("record_type = 'response'").select(
        "payload_digest", F.col("record_id").alias("refers_to_record"),
        F.col("page_id").alias("refers_to"))
    plain = records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    again = records.filter("record_type != 'response'").join(
        originals, ["payload_digest", "refers_to_record"], "left")
    return plain.unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    done = resolve(read_archive(spark, path, payload=False))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


SQL = f"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
      ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)),
      '') AS payload_digest
  FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to,
  CASE WHEN page_id = max(page_id) OVER same THEN true END AS intact
FROM coded WINDOW same AS (PARTITION BY payload_digest)
"""
