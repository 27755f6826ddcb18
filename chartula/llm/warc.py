"""WARC archives: write records, index them, read selected records back by coalesced byte ranges.

Every task writes its own archives (one gzip member a record) into the shared folder and returns an index
row per record: file, offset, length, URL, digest. The index is stored before anything is read, so a task
that is run again only leaves an unlisted file behind. Reading starts from (a selection of) the index: its
rows are gathered by stretch of file, neighbouring records become one byte range, and each range is one read.
Payloads that occur before are not stored again: such records are revisits of the first one.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartula.llm.common import shared_folder, stored

#: Payloads below this size are never revisits.
LEAST_PAYLOAD = 100
#: An archive ends after this many bytes; ranges are gathered within stretches; gaps up to this are read over.
ARCHIVE_BYTES, STRETCH_BYTES, GAP_BYTES = 256 << 20, 4 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_CONTROL = re.compile(rb"[\x00-\x20\x7f]")


def _opened(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def _id(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record. A revisit keeps the HTTP header, which tells the payload's size."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _id(page_id), b"WARC-Date: " + DATE.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _CONTROL.sub(lambda m: b"%%%02X" % m.group()[0], url.encode()))
    lines.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if refers_to is None:
        block += payload
    else:
        lines += [b"WARC-Refers-To: " + _id(refers_to), b"WARC-Profile: " + PROFILE.encode()]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple:
    """The fields of RECORD_SCHEMA. A response whose payload does not have its stated digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
    kind = fields[b"WARC-Type"].decode()
    number = lambda value: None if value is None or value == b"<urn:page:null>" else int(value[10:-1])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields[b'WARC-Record-ID']!r}")
    url = fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None
    return number(fields[b"WARC-Record-ID"]), url, size, digest, kind, number(fields.get(b"WARC-Refers-To")), payload if kind == "response" else None


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                record = gzip.compress(encode_record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"]), 6, mtime=0)
                out.write(record)
                kind = "response" if row["refers_to"] is None else "revisit"
                rows.append((row["page_id"], row["url"], row["payload_digest"], kind, name, at, len(record)))
                at += len(record)
            types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()]
            names = ["page_id", "url", "payload_digest", "record_type", "file", "offset", "length"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` below ``folder``; the index (INDEX_SCHEMA).

    Of the rows with equal payloads of at least LEAST_PAYLOAD bytes, those with the smallest page_id (a
    null id counts as the largest) are responses, the others revisits of it. A null html is an empty
    payload, rows are never merged, an empty table gives no record, other columns are not read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    large = rows.filter(F.length("payload") >= LEAST_PAYLOAD)
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("payload_digest", "first")
    refers = F.when((F.length("payload") >= LEAST_PAYLOAD) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    records = rows.join(first, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))
    return stored(records.mapInArrow(_writer(folder), INDEX_SCHEMA), "warc-index")


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                with files.open_input_file(f"{root}/{row['file']}") as archive:
                    for run in coalesced([(r["offset"], r["length"]) for r in row["records"]]):
                        start = run[0][0]
                        archive.seek(start)
                        data = archive.read(run[-1][0] + run[-1][1] - start)
                        for offset, length in run:
                            fields = decode_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                            rows.append(fields if with_payload else (*fields[:-1], None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return read


def coalesced(records: list[tuple[int, int]], gap: int = GAP_BYTES) -> list[list[tuple[int, int]]]:
    """(offset, length) of one file, in order, as runs whose gaps are at most ``gap`` bytes."""
    runs: list[list[tuple[int, int]]] = []
    for offset, length in sorted(records):
        if runs and offset - sum(runs[-1][-1]) <= gap:
            runs[-1].append((offset, length))
        else:
            runs.append([(offset, length)])
    return runs


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` (or a selection of it) lists, as RECORD_SCHEMA; revisits have no payload."""
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    reads = index.groupBy("file", stretch.alias("stretch")).agg(F.collect_list(F.struct("offset", "length")).alias("records"))
    # The index is small beside what it points at, so its size must not decide on the number of tasks.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reads.select("file", "records").repartition(tasks).mapInArrow(_reader(folder, with_payload), RECORD_SCHEMA)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read all records back (without payloads)."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder, with_payload=False).drop("payload")
