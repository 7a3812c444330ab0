"""WARC: pages as transactions of request, response or revisit and metadata records, and back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import landed, shared_path, ship_package
from .texts import quoted

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

RECORD = (
    "record_type string, record_id string, concurrent_to string, target_uri string, refers_to_record string, "
    "page_id string, payload_bytes long, payload_digest string, payload binary"
)
_ARROW = pa.schema([
    (n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in RECORD.split(", "))
])


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row: int, kind: str) -> str:
    h = hashlib.sha256(f"{row}:{kind}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return VERSION + f"\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def transaction(row: int, page: str | None, url: str | None, html: bytes, leader: int, date: str) -> Iterator[bytes]:
    """The three records of one page; ``leader`` is the row whose response has the payload."""
    # a header holds one line of visible characters
    uri = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    host, _, path = (uri or "").partition("://")[2].partition("/")
    kind = "response" if leader == row else "revisit"
    main = record_id(row, "capture")
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    asked = f"GET /{path.partition('#')[0]} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    yield _record([
        ("WARC-Type", "request"), ("WARC-Record-ID", record_id(row, "request")), *common,
        ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request"),
    ], asked)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    yield _record([
        ("WARC-Type", kind), ("WARC-Record-ID", main), *common,
        ("WARC-Payload-Digest", f"sha1:{digest_of(html)}"), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Profile", REVISIT_PROFILE if kind == "revisit" else None),
        ("WARC-Refers-To", record_id(leader, "capture") if kind == "revisit" else None),
    ], head if kind == "revisit" else head + html)
    about = "" if page is None else f"page_id: {quote(page, safe='')}\r\n"
    yield _record([
        ("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(row, "metadata")), *common,
        ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields"),
    ], about.encode())


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
    revisit_from_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", records_per_archive: int = 30_000,
) -> None:
    """Write archives under ``path``, by Spark's text sink, so to any file system that Spark reaches.

    Of rows with equal payloads of at least ``revisit_from_bytes`` bytes, that with the smallest key is the
    response (null keys last; of repeated rows any one), the others are revisits of it. A null html is an empty
    payload; a null url leaves the target out; a null key leaves it out of the metadata. Keys are of any type that
    orders and has a text form. An archive has ``records_per_archive`` records at most, so that readers can hold it.
    Other columns are not archived. An empty table makes empty archives.
    """
    spark = pages.sparkSession
    ship_package(spark)
    # written once, so that row numbers and digests stay the same for both uses and for a repeated task
    rows = _stored(pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(quoted(key)).alias("page"), F.col(quoted(url)).alias("url"),
        F.coalesce(F.col(quoted(html)), F.lit("")).cast("binary").alias("html"),
    ).withColumn("digest", F.unhex(F.sha1("html"))).withColumn("many", F.length("html") >= revisit_from_bytes))
    small = rows.select("row", "page", "digest", "many")
    first = F.min(F.struct(F.col("page").isNull().alias("none"), "page", "row"))
    # payloads with copies only: most have none and stay out of the join; written, so that AQE can split a hot one
    leaders = landed(
        small.where("many").groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1).select("digest", F.col("first.row").alias("leader"))
    )
    revisits = small.where("many").join(leaders, "digest").where(F.col("row") != F.col("leader")).select("row", "leader")
    named = rows.drop("digest", "many").withColumn("page", F.col("page").cast("string"))
    joined = named.join(revisits, "row", "left")
    columns = ["row", "page", "url", "html", "leader"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                made = [
                    r for row, page, url, html, leader in zip(*(part.column(c).to_pylist() for c in columns), strict=True)
                    for r in transaction(row, page, url, html, row if leader is None else leader, date)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()).cast(pa.string(), safe=False)], names=["value"])

    records = joined.select(columns).mapInArrow(run, "value string")
    writer = records.write.option("lineSep", END).option("compression", compression)
    writer.option("maxRecordsPerFile", records_per_archive).text(path)


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back; payloads pack well."""
    path = shared_path(df.sparkSession, "pages")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parse_records(content: bytes, keep_payload: bool = True) -> Iterator[tuple]:
    """Records of an archive, plain or in gzip members, by their Content-Length; a payload may hold anything.

    Unpacks as it goes, so that it holds one record besides the archive's own bytes."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        headers = {}
        if line.startswith(b"WARC/"):
            while (field := stream.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = field.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
        if "content-length" not in headers:
            raise ValueError("not a WARC record: " + repr(line[:80]))
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("an archive ends within a record")
        kind, page, payload = headers.get("warc-type"), None, None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
            page = unquote(fields["page_id"]) if "page_id" in fields else None
        yield (
            kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-target-uri"),
            headers.get("warc-refers-to"), page, None if payload is None else len(payload),
            headers.get("warc-payload-digest", "").removeprefix("sha1:") or None if payload is None else digest_of(payload),
            payload if keep_payload else None,
        )


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True, key_type: str = "bigint") -> DataFrame:
    """One row for each record of the archives under ``path``, plain or gzip. A response's payload_bytes and
    payload_digest are taken from its payload, a revisit's digest from its header; a page_id that is not of
    ``key_type`` is null. A broken archive fails."""
    ship_package(spark)

    def packed(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*found, strict=True), _ARROW.types, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                waiting, size = [], 0
                for record in parse_records(content, keep_payload):
                    waiting.append(record)
                    size += 200 + len(record[-1] or b"")
                    if size > 4 << 20:
                        yield packed(waiting)
                        waiting, size = [], 0
                if waiting:
                    yield packed(waiting)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD).withColumn("page_id", F.col("page_id").try_cast(key_type))


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its request and metadata, found through their concurrent-to identifiers,
    and the response it is or revisits.

    Captures without a request or metadata record stay, with nulls. Records of other types are left out; a
    repeated request or metadata record of one capture counts once (the smallest record id).
    """
    main = records.where(F.col("record_type").isin("response", "revisit"))
    side = lambda kind, *columns: (
        records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("record_id"))
        .agg(F.min(F.struct("record_id", *columns)).alias(kind))
    )
    joined = main.join(side("request", "target_uri"), "record_id", "left").join(side("metadata", "page_id"), "record_id", "left")
    # responses that a revisit names; written, so that AQE can split the revisits of a popular one
    origin = landed(
        records.where(F.col("record_type") == "response").select(F.col("record_id").alias("refers_to_record"), "payload_bytes")
        .join(side("metadata", "page_id").select(F.col("record_id").alias("refers_to_record"), F.col("metadata.page_id").alias("page_id")), "refers_to_record", "left")
        .select("refers_to_record", F.struct("page_id", "payload_bytes").alias("origin"))
    )
    revisits = records.where(F.col("record_type") == "revisit").select("record_id", "refers_to_record").join(origin, "refers_to_record", "left")
    return joined.join(revisits.select("record_id", "origin"), "record_id", "left").select(
        F.col("metadata.page_id").alias("page_id"), "target_uri",
        F.struct("record_id", "record_type", "payload_digest", F.coalesce("payload_bytes", "origin.payload_bytes").alias("payload_bytes"), "payload").alias("capture"),
        "request", "metadata", "origin",
    )


def round_trip(pages: DataFrame, key: str = "page_id", **columns: str) -> DataFrame:
    """Write the pages to archives in the shared folder, read these back and return their captures, with keys of the
    pages' own type; other columns of the pages are not archived and don't come back."""
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, key, **columns)
    kind = pages.schema[key].dataType.simpleString()
    return captures(landed(read_warc(pages.sparkSession, path, keep_payload=False, key_type=kind)))
