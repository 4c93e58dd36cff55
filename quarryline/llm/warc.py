"""WARC archives with an index written first-class, and range reads through it.

Writing: every task turns its rows into gzip members, one record each, appends them to an
archive in the shared folder, and returns an index row per record (archive, offset, length,
url, digest, id, type). An archive's name is new for every attempt of a task, and only the
index says which archives count, so a lost executor leaves at worst an unread file.

Reading: the selected index rows are range-partitioned and sorted by (archive, offset); reads
that lie close together are coalesced, so an archive is read by few, growing offsets.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HEAVY_SHARE, heavy_values, materialize, new_path, text_or_empty

#: Payloads below this size are never revisits.
MIN_REVISIT_BYTES = 1000
#: An archive is closed beyond this size.
ARCHIVE_BYTES = 256 << 20
#: Gaps up to this size are read over; a coalesced read is at most READ_BYTES, or one record.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20
GZIP_LEVEL = 4

INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_INDEX_SCHEMA = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])


def with_record_types(pages: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to, dealt out by payload.

    Of equal payloads of at least MIN_REVISIT_BYTES bytes the one with the largest page_id is
    the response (rows that repeat that page_id too), the others revisit it; smaller ones are
    all responses. A null html is an empty payload. The responses of frequent payloads (at most
    1/share) are broadcast and their rows dealt out evenly, as small payloads are; rows of the
    other payloads meet their response by a shuffle.
    """
    payload = F.encode(text_or_empty("html"), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    key = F.sha2(F.col("payload"), 256)
    marked = own.withColumn("payload", payload).withColumn("key", F.when(F.octet_length("payload") >= MIN_REVISIT_BYTES, key)).drop("payload")
    keys = materialize(marked.select("key", "page_id").filter("key IS NOT NULL"), "payloads")
    last = F.max("page_id").alias("response")
    frequent = keys.join(F.broadcast(heavy_values(keys, "key", share)), "key", "left_semi").groupBy("key").agg(last)
    frequent = materialize(frequent.select("key", F.col("response").alias("hot_response"), F.lit(True).alias("hot")), "frequent-payloads")
    groups = keys.join(F.broadcast(frequent.select("key")), "key", "left_anti").groupBy("key").agg(last, F.count(F.lit(1)).alias("n")).filter("n > 1")
    alone = F.concat(F.lit("alone "), F.xxhash64("page_id", "url").cast("string"))
    dealt = marked.join(F.broadcast(frequent), "key", "left").withColumn("join_key", F.when(F.col("hot"), alone).otherwise(F.coalesce("key", alone)))
    joined = dealt.join(groups.select(F.col("key").alias("join_key"), "response"), "join_key", "left").withColumn("response", F.coalesce("hot_response", "response"))
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select(
        "page_id", "url", "html", F.sha1(F.encode("html", "UTF-8")).alias("digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"),
    )


def _line(value: str | None) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_line(url)}")
    if record_type == "revisit":
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record at this place: {version[:20]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        digest = hashlib.sha1(payload).hexdigest()
        if len(payload) != length or digest != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
            raise ValueError("a record's payload doesn't have its digest or length")
    ids = [None if (v := fields.get(k)) is None or v == "<urn:page:none>" else int(v[len("<urn:page:") : -1]) for k in ("WARC-Record-ID", "WARC-Refers-To")]
    return ids[0], fields.get("WARC-Target-URI"), length, digest, kind, ids[1], payload if kind == "response" else None


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns their index, itself a table in the shared folder.

    pages is the result of with_record_types().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, kind, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(record_bytes(page_id, url, html.encode(), digest, kind, refers_to), GZIP_LEVEL, mtime=0)
                out.write(member)
                rows.append((name, at, len(member), url, digest, page_id, kind))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX_SCHEMA, strict=True)], schema=_INDEX_SCHEMA)
        if out is not None:
            out.close()

    index = pages.select("page_id", "url", "html", "digest", "record_type", "refers_to").mapInArrow(run, INDEX)
    return materialize(index, "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) ranges as (start, end, numbers of the ranges within)."""
    out: list[list] = []
    for i, (offset, length) in enumerate(ranges):
        end = offset + length
        if out and offset - out[-1][1] <= gap and end - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2].append(i)
        else:
            out.append([offset, end, [i]])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records that index rows name, parsed and checked against their digests.

    index is any selection of the index: only the archives' bytes around it are read. Without
    payload that column is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        source, opened = None, None
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            archives, offsets, lengths = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(archives):
                to = at
                while to < len(archives) and archives[to] == archives[at]:
                    to += 1
                if opened != archives[at]:
                    if source is not None:
                        source.close()
                    opened, source = archives[at], fs.open_input_file(f"{base}/{archives[at]}")
                ranges = list(zip(offsets[at:to], lengths[at:to], strict=True))
                for start, end, held in coalesced(ranges):
                    data = source.read_at(end - start, start)
                    rows = [parse_record(zlib.decompress(data[ranges[i][0] - start : ranges[i][0] - start + ranges[i][1]], wbits=31)) for i in held]
                    if not payload:
                        rows = [(*r[:-1], None) for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                at = to
        if source is not None:
            source.close()

    wanted = index.select("archive", "offset", "length")
    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = wanted.repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame) -> tuple[DataFrame, str]:
    """Writes all pages; the index and the folder of the archives."""
    folder = new_path(pages.sparkSession, "warc")
    return write_archives(with_record_types(pages), folder), folder
