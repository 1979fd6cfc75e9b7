"""WARC archives: writing pages as records, reading them back by byte ranges.

Every record is a gzip member of its own, and members stand back to back. Writing is a text sink, so that Spark commits
the files: a row is a member without its last byte, which is zero as long as a record is below 16 MiB, and a zero byte
is the sink's line separator. (Larger records are followed by an empty member, which also ends in zero.) Reading is
splittable: the files' lengths are dealt out as byte ranges, and a task scans its range for the gzip magic, takes a
candidate for a record only if it inflates to a WARC header, and owns the records that start inside its range, reading
past the range's end where a record does.
"""

from __future__ import annotations

import hashlib
import zlib
from datetime import UTC, datetime
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, load, materialize, work_path

MAGIC = b"\x1f\x8b\x08"
#: bytes of a range, and of a read
RANGE_BYTES, READ_BYTES = 16 << 20, 1 << 20
#: most tasks of a read; ranges beyond that many share tasks
MOST_TASKS = 50_000
#: equal payloads from this size on become one response and revisits
REVISIT_BYTES = 1000
RECORD_SCHEMA = "record_type string, target_uri string, record_id string, refers_to string, digest string, payload_bytes long, payload_digest string, payload binary"


def with_revisits(pages: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Adds _payload, _digest and, for copies of a payload of at least `least` bytes, _first: the largest id among them."""
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.withColumn("_payload", payload).withColumn("_digest", F.sha1("_payload"))
    large, small = F.octet_length("_payload") >= least, F.octet_length("_payload") < least
    first = rows.filter(large).groupBy("_digest").agg(F.max(id_col).alias("_first"), F.count(F.lit(1)).alias("_copies"))
    first = materialize(first.filter("_copies > 1"), "warc-copies")
    copies = join_spread(rows.filter(large), first, "_digest", "_copies", [id_col, "_digest"], "left").drop("_copies")
    return copies.unionByName(rows.filter(small).withColumn("_first", F.lit(None).cast("long")))


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def up_to_zero(member: bytes) -> bytes:
    """A member, and an empty one if need be, without the zero byte at the end."""
    return (member if member.endswith(b"\0") else member + gzip_member(b""))[:-1]


def record(kind: str, uri: str, page_id, refers_to, digest: str, payload: bytes, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record. A revisit holds the full payload's digest and length in place of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Date: {date}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI: " + "".join(c for c in uri if c >= " "),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip_member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = REVISIT_BYTES, date: str | None = None) -> None:
    """Writes one record per row. Of rows with equal payloads of at least `least` bytes, that with the largest
    id is the response and the others revisit it; a row with a null id is always a response. date is the records'
    WARC-Date, by default the time of writing. Files end in .warc.gz."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def build(batches):
        for batch in batches:
            out = []
            for page_id, uri, first, digest, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                again = first is not None and page_id is not None and page_id != first
                out.append(record("revisit" if again else "response", uri or "", page_id, first, digest, payload, date))
            yield pa.RecordBatch.from_arrays([pa.array([up_to_zero(m) for m in out], pa.binary())], names=["member"])

    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(text_col).alias("html"))
    rows = with_revisits(pages, "page_id", "html", least)
    members = rows.select("page_id", "url", "_first", "_digest", "_payload").mapInArrow(build, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    name_archives(pages.sparkSession, path)


def name_archives(spark: SparkSession, path: str) -> None:
    """Gives the committed text files the ending of archives."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "part-*.txt")):
        old = file.getPath()
        store.rename(old, spark._jvm.org.apache.hadoop.fs.Path(at, old.getName().removesuffix(".txt") + ".warc.gz"))


class Range:
    """Bytes of a file from an offset on, read as they are needed."""

    def __init__(self, file, start: int, size: int) -> None:
        self.file, self.at, self.size, self.held = file, start, size, bytearray()

    def need(self, n: int) -> bool:
        """Holds at least n bytes from the current place on, if the file has as many."""
        while len(self.held) < n:
            more = self.file.read_at(min(READ_BYTES, self.size - self.at - len(self.held)), self.at + len(self.held))
            if not more:
                return False
            self.held += more
        return True

    def skip(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def inflate(source: Range, whole: bool) -> tuple[bytes, int] | None:
    """Data and compressed length of the member at the current place; without whole, its first bytes only."""
    z, out, n = zlib.decompressobj(31), bytearray(), 0
    try:
        while not z.eof:
            if not source.need(n + 1):
                return None
            piece = bytes(source.held[n : n + (READ_BYTES if whole else 512)])
            out += z.decompress(piece, 0 if whole else 64)
            n += len(piece)
            if not whole and len(out) >= 8:
                break
    except zlib.error:
        return None
    return bytes(out), n - len(z.unused_data)


def parse(data: bytes) -> tuple | None:
    head, found, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        block = block[: int(fields.get("content-length", ""))]
    except ValueError:
        return None
    http, _, body = block.partition(b"\r\n\r\n")
    kind, digest, length = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:"), len(body)
    own = hashlib.sha1(body).hexdigest()
    if kind == "revisit":  # the full payload's length and digest stand in the headers
        own = digest
        for x in http.decode("latin-1").split("\r\n"):
            if x.lower().startswith("content-length:"):
                length = int(x.partition(":")[2])
    strip = lambda x: x.removeprefix("<").removesuffix(">")
    return kind, fields.get("warc-target-uri"), strip(fields.get("warc-record-id", "")), strip(fields.get("warc-refers-to", "")) or None, digest, length, own, body


def records_in(file, size: int, start: int, end: int):
    """Records whose gzip member starts in [start, end)."""
    source = Range(file, start, size)
    while source.at < end:
        if not source.need(len(MAGIC)):
            return
        i = source.held.find(MAGIC)
        if i < 0:  # keep what may be the start of a magic
            source.skip(len(source.held) - len(MAGIC) + 1)
            if not source.need(len(MAGIC)):
                return
            continue
        source.skip(i)
        if source.at >= end:
            return
        head = inflate(source, whole=False)
        whole = inflate(source, whole=True) if head and head[0].startswith(b"WARC/") else None
        row = parse(whole[0]) if whole else None
        if row:
            yield row
        source.skip(whole[1] if row else 1)


def open_file(path: str):
    """A file on any store that Arrow reaches, and its path there."""
    from pyarrow import fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(url.path))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under path: record_type, target_uri, record_id, refers_to, digest (as
    the record states it), payload_bytes, payload_digest (of the payload read; a revisit's as stated), payload.

    A folder without files gives no rows. What is no WARC record is passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    step = F.lit(range_bytes)
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step.cast("long"))).alias("start"))
    # a given number: Spark would else put what are tiny rows here, however much they stand for, into few tasks
    ranges = ranges.repartitionByRange(max(1, min(ranges.count(), MOST_TASKS)), "path", "start")

    def scan(batches):
        for batch in batches:
            for file_path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, bytes_held = [], 0
                with open_file(file_path) as file:
                    for row in records_in(file, size, start, min(start + range_bytes, size)):
                        held.append(row if with_payload else (*row[:-1], None))
                        bytes_held += len(row[-1])
                        if bytes_held > 8 << 20 or len(held) >= 5000:
                            yield to_batch(held)
                            held, bytes_held = [], 0
                if held:
                    yield to_batch(held)

    return ranges.mapInArrow(scan, RECORD_SCHEMA)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    names = ["record_type", "target_uri", "record_id", "refers_to", "digest", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Writes pages as WARC archives to the shared folder and reads them back: id_col, payload_bytes,
    payload_digest (SHA-1 of the full payload), record_type, refers_to (the response's id for revisits).

    A null payload is an empty one, a null url an empty one; a null id stays null and never revisits. Rows that
    repeat the response's id are responses too. A record is held whole by the task that writes or reads it, however
    long. An empty table gives no rows; extra columns are ignored.
    """
    path = work_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col, url_col, text_col)
    records = read_warc(pages.sparkSession, path, with_payload=False)
    number = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast("long")
    return records.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op5(spark, sf_dir):
    return warc_round_trip(load(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM m
"""
