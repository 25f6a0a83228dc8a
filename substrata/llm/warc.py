"""WARC archives as a chunked record table.

A payload travels as rows of (record, chunk number, bytes), in order, so that
neither writer nor reader holds a whole record. Digests are carried along from
chunk to chunk. Archives are .warc.gz files, a gzip member a record, in a
folder that all executors share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from substrata.llm.common import cut, remove, small, table, work_path

CHUNK_BYTES = 1 << 18
#: Payloads that occur more than once, in so many kinds at most, are broadcast (a digest and an id each).
BROADCAST_DIGESTS = 500_000

_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
_MANIFEST = "path string, records bigint, payload_bytes bigint"
_CHUNKS = "record_id string, page_id bigint, url string, record_type string, refers_to bigint, chunk_no bigint, chunk binary, bytes_so_far bigint, sha1_so_far string, payload_bytes bigint, payload_digest string, last boolean, intact boolean"


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


@contextmanager
def _writer(path: str):
    """A file that appears under its name only when complete: a lost or repeated task leaves no torn archive."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        scratch = f"{url.path}.{uuid.uuid4().hex}"
        with open(scratch, "wb") as f:
            yield f
        os.replace(scratch, url.path)
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        scratch = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(scratch) as f:
            yield f
        store.move(scratch, name)


def _reader(path: str):
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(url.path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_stream(name)


def _line(value: str) -> str:
    """A header value on one line; other control characters and spaces of a URL are escaped too."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: quote(m[0]), value)


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_IDS, f'{page_id} {digest}')}"


def _header(row: dict) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP head of a record."""
    digest, revisit = base32_sha1(row["sha1"]), row["keeper"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(row['page_id'], digest)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_line(row['url'])}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['size']}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(row['keeper'], digest)}>", f"X-Refers-To-Page: {row['keeper']}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else row['size'])}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def _write(folder: str):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = f"{folder}/part-{TaskContext.get().partitionId():07d}.warc.gz"
        records = size = 0
        with _writer(path) as out:
            gz = None
            for batch in batches:
                chunks = batch.column("chunk")
                for i, row in enumerate(batch.drop_columns(["chunk"]).to_pylist()):
                    if row["chunk_no"] == 0:
                        gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                        warc, http = _header(row)
                        out.write(gz.compress(warc + http))
                        records, size = records + 1, size + row["size"]
                    if row["keeper"] is None:
                        out.write(gz.compress(chunks[i].as_buffer()))
                    if row["last"]:
                        out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        if records:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "payload_bytes": [size]})

    return part


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a record for each row, now, in a file for each task; return the table of files (path, records, payload_bytes).

    Of rows with equal payloads of min_bytes or more, the one with the largest
    id keeps the payload as a response and the others are revisits that refer
    to it; rows that share the largest id are all responses. Rows whose
    payload has no id at all are responses. Null payloads are empty, null URLs
    leave the field out. Repeated rows have a record each. Payloads of any
    length are written in chunks of chunk_bytes. Other columns are left out.
    Empty table: no files.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    kept = rows.where(F.col("size") >= min_bytes).groupBy(F.col("sha1").alias("of")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    kept = cut(kept.where("n > 1 AND keeper IS NOT NULL").select("of", "keeper"))
    rows = rows.join(small(kept, BROADCAST_DIGESTS), F.col("sha1") == F.col("of"), "left").drop("of")
    rows = rows.withColumn("keeper", F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")))
    held = F.when(F.col("keeper").isNull(), F.col("size")).otherwise(F.lit(0))  # a revisit has no payload to carry
    rows = rows.withColumn("n_chunks", F.greatest(F.ceil(held / F.lit(chunk_bytes)), F.lit(1)).cast("int"))
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    chunk = F.when(F.col("keeper").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    rows = rows.select("page_id", "url", "sha1", "size", "keeper", "chunk_no", chunk.alias("chunk"), (F.col("chunk_no") == F.col("n_chunks") - 1).alias("last"))
    return cut(rows.mapInArrow(_write(folder), _MANIFEST))


def parse_records(stream, chunk_bytes: int = CHUNK_BYTES, payload: bool = True) -> Iterator[dict]:
    """Chunk rows of a WARC stream: each with the bytes and SHA-1 of the payload up to it; intact is set on the last."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        left = int(fields["content-length"])
        while left and (line := stream.readline()):  # the HTTP head isn't payload
            left -= len(line)
            if not line.strip():
                break
        revisit, said = fields["warc-type"] == "revisit", fields["warc-payload-digest"].removeprefix("sha1:")
        number = lambda key: int(fields[key]) if key in fields else None
        row = {"record_id": fields["warc-record-id"].strip("<>"), "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": number("x-refers-to-page")}
        sha1, done, chunk_no = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(left, chunk_bytes)) if left else b""
            left -= len(data)
            done += len(data)
            sha1.update(data)
            last = not left or not data
            found = base64.b32encode(sha1.digest()).decode()
            whole = number("x-payload-length") if revisit else done
            yield row | {
                "chunk_no": chunk_no, "chunk": data if payload else None, "bytes_so_far": done, "sha1_so_far": sha1.hexdigest(), "payload_bytes": whole if last else None,
                "payload_digest": (said if revisit else found) if last else None, "last": last, "intact": (revisit or found == said and done == number("x-payload-length")) if last else None,
            }
            if last:
                break
            chunk_no += 1


def read_archives(files: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, payload: bool = True) -> DataFrame:
    """The chunked record table of the archives that `path` of each row names; without payload, chunk is null."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_()), ("intact", pa.bool_())])
    rows_at_once = max(1, (1 << 24) // chunk_bytes) if payload else 2_000

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _reader(path) as f, gzip.GzipFile(fileobj=f) as stream:
                    rows = []
                    for row in parse_records(stream, chunk_bytes, payload):
                        rows.append(row)
                        if len(rows) == rows_at_once:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path").mapInArrow(part, _CHUNKS)


def op8_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, read them back, delete the archives; what was read is in the shared folder."""
    folder = work_path(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), folder)
    out = cut(read_archives(files, payload=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact"))
    remove(spark, folder)
    return out


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: RFC 4648
ORACLE = f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
    h AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper FROM h)
    SELECT page_id, url, payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', (((('0x' || substr(hex, (5 * (i // 4) + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
           CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> keeper THEN keeper END AS refers_to, true AS intact
    FROM k"""
