"""WARC archives: one gzip member per record, read back sequentially.

Writing: each task packs its rows into archives of bounded size, kept as binary rows of a Parquet
table in the shared folder, so no executor needs a folder of its own. Of records with equal
payloads of at least `least` bytes, the one with the largest id is a response and the others are
revisits that name it; smaller payloads are all responses.

Reading: an archive is consumed from start to end by an incremental zlib decompressor fed with small
blocks. A member's header block is parsed up to its empty line, content-length says how much block
follows, and the block must end where the member ends. Response payloads are held against their
digest; a record that is cut short, overruns or doesn't match raises an error.

A null payload counts as an empty one. Rows that repeat the largest id of a payload are all
responses. Rows with a null id keep it, and can't be referred to. Columns beside id, url and payload
are ignored; an empty table gives no archives and no records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import as_bytes, checkpointed, stored

#: Revisits up to which their marks, some 60 bytes each, are broadcast, so that payloads stay where they are; more are joined by a shuffle.
BROADCAST_MARKS = 200_000
#: Compressed bytes after which a new archive is begun, and bytes fed to the reader at a time.
ARCHIVE_BYTES, FEED = 16 << 20, 1 << 16
URN = "urn:x-page:"


def sha1_hex(payload: bytes) -> str:
    return hashlib.sha1(payload, usedforsecurity=False).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as one gzip member."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    uri = "".join(c for c in (url or "") if c.isprintable() and c != " ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def members(feed: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, each decompressed piece by piece."""
    rest, unpack, parts = b"", None, []
    for piece in feed:
        rest += piece
        while rest:
            unpack = unpack or zlib.decompressobj(31)
            parts.append(unpack.decompress(rest))
            rest = b""
            if unpack.eof:
                rest, unpack = unpack.unused_data, None
                yield b"".join(parts)
                parts = []
    if unpack is not None:
        raise ValueError("the last member is cut short")


def headers(block: bytes, at: int = 0) -> tuple[str, dict[str, str], int]:
    """(first line, fields by lower-case name, where the body starts) of a header block."""
    end = block.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("a header block has no end")
    first, *lines = block[at:end].decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def records(feed: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes | None, int]]:
    """(fields, payload or None for a revisit, bytes of the full payload) of each record, verified."""
    for plain in members(feed):
        first, fields, at = headers(plain)
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        size = int(fields["content-length"])
        if len(plain) != at + size + 4 or plain[-4:] != b"\r\n\r\n":
            raise ValueError("content-length doesn't frame the record")
        block = plain[at : at + size]
        if "http" not in fields.get("content-type", ""):
            yield fields, block, size
            continue
        _, http, body = headers(block)
        payload = block[body:] if fields["warc-type"] == "response" else None
        length = int(http.get("content-length", len(block) - body))
        if payload is not None:
            kind, _, digest = fields["warc-payload-digest"].partition(":")
            if kind != "sha1" or sha1_hex(payload) != digest or len(payload) != length:
                raise ValueError(f"the payload of {fields['warc-record-id']} doesn't match its digest")
        yield fields, payload, length


def revisits(df: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """(id, digest, refers_to) of the rows that revisit another, from ids and digests alone."""
    data = F.coalesce(F.col(payload_col), F.lit(""))
    narrow = checkpointed(df.where((F.octet_length(data) >= least) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha1(data.cast("binary")).alias("digest")))
    groups = checkpointed(narrow.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return narrow.join(groups, "digest").where("id < refers_to").select("id", "digest", "refers_to").distinct()


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): whole .warc.gz files of at most about archive_bytes, or one record, each."""
    marks = checkpointed(revisits(df, id_col, payload_col, least))
    if marks.count() <= BROADCAST_MARKS:
        marks = F.broadcast(marks)
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.coalesce("payload", F.lit("")).cast("binary")))
    rows = rows.join(marks, ["id", "digest"], "left").select("id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{count:06d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            ids, urls, digests, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for page_id, url, payload, digest, to in zip(ids, urls, as_bytes(batch.column(2)), digests, refers, strict=True):
                parts.append(record(page_id, url, payload or b"", digest, to))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield archive()
                    count, parts, size = count + 1, [], 0
        if parts:
            yield archive()

    return stored(rows.mapInArrow(run, "archive string, content binary"), "warc", "none")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of (archive, content) rows, in the style of a sequential reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "record_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(content.as_buffer())
                rows, held = [], 0
                for fields, payload, length in records(bytes(view[i : i + FEED]) for i in range(0, len(view), FEED)):
                    bare = lambda k, f=fields: f[k].strip("<>") if k in f else None
                    rows.append((name, bare("warc-record-id"), bare("warc-target-uri"), fields["warc-type"], bare("warc-refers-to"), fields.get("warc-payload-digest", "").partition(":")[2], length, payload if payloads else None))
                    held += len(payload or b"") if payloads else 0
                    if len(rows) >= 4096 or held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "archive string, record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
    return archives.select("archive", "content").mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc.gz files in any store that Spark reads."""
    files = spark.read.format("binaryFile").load(path)
    return read_archives(files.select(F.col("path").alias("archive"), "content"))


def digest(records_read: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The contract's columns from the records read back."""

    def number(column):
        return F.regexp_extract(column, rf"^{URN}(-?\d+)$", 1)

    def page(column):
        return F.when(number(column) != "", number(column)).cast(id_type)

    return records_read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
