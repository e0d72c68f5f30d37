"""WARC archives: a writer and a sequential reader, one gzip member per record."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import common

#: Payloads of fewer bytes are always written out.
LEAST_REVISIT = 100
#: Compressed bytes after which a task begins another archive, and bytes read at a time.
ARCHIVE_BYTES, BLOCK = 1 << 30, 1 << 16
#: Rows and payload bytes of a batch the reader hands on.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:leafmill:page:"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, uncompressed. A revisit has the headers of its response but no payload."""
    digest = hashlib.sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member, the same bytes each time."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(stream: BinaryIO, name: str = "") -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member in turn, decompressed as blocks come in."""
    offset = consumed = 0
    pending = b""
    while True:
        pending = pending or stream.read(BLOCK)
        if not pending:
            return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not pending and not (pending := stream.read(BLOCK)):
                raise ValueError(f"{name}: the member at {offset} ends early")
            try:
                parts.append(unpack.decompress(pending))
            except zlib.error as e:
                raise ValueError(f"{name}: the member at {offset} is damaged: {e}") from e
            consumed += len(pending) - len(unpack.unused_data)
            pending = unpack.unused_data
        yield offset, b"".join(parts)
        offset = consumed


def parse(data: bytes, where: str = "") -> dict:
    """Header fields (lower-case names) and block of the one record in ``data``, framed by its length and verified by its digests."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n") if end >= 0 else [""]
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"{where}: no WARC header")
    head: dict = {}
    for line in lines[1:]:
        name, found, value = line.partition(":")
        if not found:
            raise ValueError(f"{where}: header line {line[:80]!r}")
        head[name.strip().lower()] = value.strip()
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError) as e:
        raise ValueError(f"{where}: no valid content-length") from e
    block = data[end + 4 : end + 4 + length]
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError(f"{where}: the record is not as long as its content-length says")
    _verify(head.get("warc-block-digest"), block, where, "block")
    http, _, payload = block.partition(b"\r\n\r\n")
    if head.get("warc-type") == "response":
        _verify(head.get("warc-payload-digest"), payload, where, "payload")
    sizes = [x for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")]
    return head | {"block": block, "payload": payload, "payload_bytes": int(sizes[0].partition(":")[2]) if sizes else len(payload)}


def _verify(stated: str | None, data: bytes, where: str, what: str) -> None:
    if stated:
        kind, _, value = stated.partition(":")
        if kind == "sha256" and hashlib.sha256(data).hexdigest() != value.lower():
            raise ValueError(f"{where}: the {what} does not match its digest")


def records(stream: BinaryIO, name: str = "") -> Iterator[dict]:
    """The records of an archive in order, with ``offset``; raises at the first that is damaged."""
    for offset, data in members(stream, name):
        yield parse(data, f"{name}@{offset}") | {"offset": offset}


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI (``file:``, ``hdfs:``, ``s3:``, ``gs:``) and the path in it."""
    return pyarrow.fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` below ``folder``; returns (path, records, bytes) of the archives.

    The payload is the text in UTF-8 (null: empty). Of equal payloads of at least ``least`` bytes the
    one with the smallest id is a response and the others revisit it; rows that repeat that id are
    responses too, and rows without an id revisit it if another has one.

    Smallest ids are found by digest, with partial sums before the shuffle; they are joined to the
    pages on the digest, whose other side has one row a digest, so Spark can split a payload that many
    pages share. Tasks write files of names of their own and the returned table lists the files of
    tasks that ended well; what a lost task left is on no list and is not read.
    """
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    sized = pages.select(F.col(id_col).cast("long").alias("id"), payload.alias("payload")).where(F.length("payload") >= least).select("id", F.sha2("payload", 256).alias("digest"))
    first = sized.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("__digest"), "first")
    marked = rows.join(first, F.col("digest") == F.col("__digest"), "left").select("id", "url", "payload", F.expr("if(first is null or id <=> first, null, first)").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        out, done, name, count, size = None, [], "", 0, 0
        for part in (b.slice(low, 64) for b in batches for low in range(0, b.num_rows, 64)):  # copies few payloads at a time
            for page_id, url, data, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                packed = member(record_bytes(page_id, url, data, refers_to))
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x, strict=True)) for x in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    listed, _ = common.written(marked.mapInArrow(write, "path string, records long, bytes long"), "archives")
    return listed


def read_archives(spark: SparkSession, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives named in column ``path`` of ``files``, each read in order by one task.

    (path, offset, page_id, record_type, url, payload_bytes, payload_digest, refers_to[, payload]); ids
    are null where a record has another kind of id.
    """
    schema = "path string, offset long, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload

    def of(value: str | None) -> int | None:
        number = (value or "").strip("<>").removeprefix(ID)
        return int(number) if number.removeprefix("-").isdigit() else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _file_system(path)
                rows, size = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for r in records(stream, path):
                        digest = (r.get("warc-payload-digest") or "").partition(":")[2] or None
                        row = {"path": path, "offset": r["offset"], "page_id": of(r.get("warc-record-id")), "record_type": r.get("warc-type"), "url": r.get("warc-target-uri"), "payload_bytes": r["payload_bytes"], "payload_digest": digest, "refers_to": of(r.get("warc-refers-to"))}
                        rows.append(row | {"payload": r["payload"]} if with_payload else row)
                        size += len(r["payload"])
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    paths = files.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(read, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from archives written and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_archives(pages, common.scratch_path(spark, "warc"))
    found = read_archives(spark, files, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same from the pages alone, in DuckDB's SQL.
SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
