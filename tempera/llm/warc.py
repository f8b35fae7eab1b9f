"""WARC archives of web pages: one gzip member a record, read back by byte ranges.

Writing: a task writes one archive; its name holds the task attempt, and only archives
listed by attempts that Spark committed are read, so a repeated task leaves nothing double.
Reading: archives are dealt out as byte ranges. A task looks for gzip magic from the
start of its range, accepts a candidate only if the member inflates to a WARC record
with sound headers, and owns the records that start inside the range; the last
one may end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.plans.staging import materialize, staged_path

#: Shorter payloads are always stored again.
REVISIT_BYTES = 1000
RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
FEED_BYTES = 1 << 13

# Gzip magic with deflate, record head, line ends of the formats.
MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1."
CRLF = b"\r\n"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the session's default file system has it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(r"^file:/+", "file:///", system.makeQualified(folder).toString())


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(quote(re.sub(r"^s3[an]:", "s3:", uri), safe="/:@?&=%"))


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to: the largest page_id of equal payloads is the response.

    Null html is an empty payload. Rows that tie for the largest page_id are all
    responses; a row without page_id is a revisit if its payload has a row with one.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    groups = (
        base.filter(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select(F.col("digest").alias("g_digest"), "keeper")
    )
    revisit: Column = F.coalesce(F.col("keeper") > F.col("page_id"), F.col("keeper").isNotNull())
    return base.join(groups, F.col("digest") == F.col("g_digest"), "left").select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def _identity(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(identity: str) -> int | None:
    digits = identity[len("<urn:page:") : -1]
    return int(digits) if digits else None


def encode_record(page_id, url, payload: bytes, digest: str, record_type: str, refers_to, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if record_type == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {_identity(page_id)}",
        f"WARC-Date: {date}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # Bytes a header line can't hold are percent-encoded.
        line = re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8")).decode()
        lines.append(f"WARC-Target-URI: {line}")
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: {_identity(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode("ascii") + END + block + END


def write_archives(records: DataFrame, path: str, level: int = 6, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write records, an archive a task, and return (path, bytes, records) of the archives."""
    target = qualified(records.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _file_system(target)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        out, size, count = None, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(encode_record(*row, date)) + member.flush()
                out.write(data)
                size, count = size + len(data), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{target}/{name}"], "bytes": [size], "records": [count]})

    columns = ["page_id", "url", "payload", "digest", "record_type", "refers_to"]
    return records.select(*columns).mapInArrow(write, "path string, bytes long, records long")


def decode_record(data: bytes) -> tuple | None:
    """(page_id, url, type, refers_to, payload bytes, digest, payload or None); None if this is no sound record."""
    cut = data.find(END)
    if not data.startswith(HEAD) or cut < 0:
        return None
    head: dict[str, str] = {}
    for line in data[:cut].split(CRLF)[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.decode("latin-1").lower()] = value.strip().decode("latin-1")
    kind, length = head.get("warc-type"), head.get("content-length", "")
    if not length.isdigit() or len(data) != cut + len(END) + int(length) + len(END):
        return None
    block = data[cut + len(END) : -len(END)]
    http, _, payload = block.partition(END)
    stated = re.search(rb"(?i)content-length: *(\d+)", http)
    digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    else:
        payload = None
    size = len(payload) if payload is not None else int(stated[1])
    refers = _page_id(head["warc-refers-to"]) if "warc-refers-to" in head else None
    return _page_id(head["warc-record-id"]), head.get("warc-target-uri"), kind, refers, size, digest, payload


class _Buffer:
    """A file's bytes from an offset on, fetched as needed and let go once passed."""

    def __init__(self, file, start: int):
        file.seek(start)
        self.file, self.base, self.data = file, start, b""

    def more(self) -> bool:
        block = self.file.read(READ_BYTES)
        self.data += block
        return bool(block)

    def drop(self, upto: int) -> None:
        """Let go of what lies before an offset, once that is worth a copy."""
        if upto - self.base >= READ_BYTES:
            self.data, self.base = self.data[upto - self.base :], upto

    def end(self) -> int:
        return self.base + len(self.data)

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The inflated member at an offset and the offset behind it; None if none is there."""
        inflate, out, used = zlib.decompressobj(31), b"", at
        while True:
            fed = self.data[used - self.base : used - self.base + FEED_BYTES]
            if not fed:
                if not self.more():
                    return None
                continue
            try:
                out += inflate.decompress(fed)
            except zlib.error:
                return None
            used += len(fed)
            if inflate.eof:
                return out, used - len(inflate.unused_data)
            if not out.startswith(HEAD[: len(out)]):
                return None


def records_in_range(file, start: int, stop: int) -> Iterator[tuple]:
    """Records whose member starts at start <= offset < stop."""
    buffer, at = _Buffer(file, start), start
    while at < stop:
        buffer.drop(at)
        found = buffer.data.find(MAGIC, at - buffer.base)
        if found < 0:
            at = max(at, buffer.end() - len(MAGIC) + 1)  # the magic may be cut by the end of what is here
            if not buffer.more():
                return
            continue
        at = buffer.base + found
        if at >= stop:
            return
        member = buffer.member(at)
        record = member and decode_record(member[0])
        if record is None:
            at += 1
            continue
        yield record
        at = member[1]


def read_archives(archives: DataFrame, payload: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of archives listed as (path, bytes); ranges of any size give the same rows."""
    spark = archives.sparkSession
    ranges = archives.filter("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = _file_system(path)
                rows, held = [], 0
                with system.open_input_file(name) as file:
                    for record in records_in_range(file, start, min(size, start + range_bytes)):
                        rows.append(record[: len(names)])
                        held += record[4] * payload
                        if len(rows) >= 2000 or held >= READ_BYTES * 8:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)

    return ranges.mapInArrow(read, RECORDS + ", payload binary" * payload)


def archive_pages(pages: DataFrame, path: str | None = None, level: int = 6) -> DataFrame:
    """Write pages (page_id, url, html) as archives and return the written archives (path, bytes, records).

    An empty table writes none; repeated rows are written as often as they
    occur; columns beside the three are ignored.
    """
    path = path or staged_path(pages.sparkSession, "warc")
    return materialize(write_archives(with_record_types(pages), path, level), "warc-list")


SQL = f"""
SELECT page_id, url, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN keeper END AS refers_to
FROM (SELECT *, strlen(body) >= {REVISIT_BYTES} AND page_id < keeper AS revisit
      FROM (SELECT page_id, url, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
            FROM pages))
"""


@llm_query("op2_warc", SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(archive_pages(table(spark, sf_dir, "pages")))
