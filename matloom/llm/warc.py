"""WARC archives by way of a chunked record table.

`chunks` turns payloads into rows of record, chunk number and at most `CHUNK` bytes, inside
the JVM; a writer task streams a record's chunks into the archive with one compressor and one
running digest, so that no Python memory holds a whole record, and the archive's reader
works in pieces of the same size. Each record is a gzip member. A task writes archives of its own
under a name that its attempt makes unique; only those in the manifest, a table written
when the tasks succeed, are read, so lost or repeated attempts leave nothing behind that counts.

Of pages with equal payloads of at least `least` bytes, the one with the largest page_id is
a `response`, the others are `revisit` records without payload that refer to it. A null html is an
empty payload; a null page_id never is the largest unless all are null (then all are responses).
Rows repeated in full have the same role. Null urls are written as about:blank. An empty
table gives no archives and no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matloom.plans.joins import broadcast_if_small
from matloom.plans.materialize import cut, fresh_path

CHUNK = 1 << 18
ROLL = 1 << 30
DATE = "2000-01-01T00:00:00Z"
ID = "urn:matloom:page:"
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
])


def open_file(uri: str, mode: str):
    """A stream on any store: the local file system for file:, else what pyarrow finds for the scheme."""
    if uri.startswith("file:") or "://" not in uri:
        path = "/" + uri.removeprefix("file:").lstrip("/")
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    return store.open_input_stream(path)


def b32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def roles(pages: DataFrame, least: int) -> DataFrame:
    """page_id, sha, refers_to of the pages that revisit another."""
    narrow = cut(pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= least).select("page_id", "sha"), "pages")
    groups = cut(narrow.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n"), "groups")
    # A payload that many pages have is one row of the groups: where these are too many to broadcast, the skewed side of the join can be split.
    return cut(narrow.hint("merge").join(broadcast_if_small(groups), "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct(), "revisits")


def chunks(pages: DataFrame, revisits: DataFrame, size: int = CHUNK) -> DataFrame:
    """page_id, url, sha, n (bytes of the payload), refers_to, chunk (number), last (number), data: payloads of responses, no data for revisits."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1("html")).withColumn("n", F.octet_length("html"))
    r = broadcast_if_small(revisits).withColumnRenamed("page_id", "own_id").withColumnRenamed("sha", "own_sha")
    p = p.hint("merge").join(r, F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("sha") == F.col("own_sha")), "left").drop("own_id", "own_sha")
    data = F.when(F.col("refers_to").isNull(), F.encode("html", "UTF-8")).otherwise(F.lit(b""))
    p = p.withColumn("data", data).withColumn("last", F.expr(f"cast(greatest(ceil(octet_length(data) / {size}) - 1, 0) as int)"))
    pieces = F.expr(f"CASE WHEN last = 0 THEN array(data) ELSE transform(sequence(0, last), i -> substring(data, i * {size} + 1, {size})) END")
    return p.select("page_id", "url", "sha", "n", "refers_to", "last", F.posexplode(pieces).alias("chunk", "data"))


def header(page_id, url, sha: str, n: int, refers_to) -> tuple[bytes, bytes]:
    """The record's header, and the HTTP header before the payload."""
    http = b"" if refers_to is not None else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=SAFE) if url else 'about:blank'}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{b32(bytes.fromhex(sha))}",
        f"X-Payload-Length: {n}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines.append(f"Content-Length: {len(http) + (n if refers_to is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


SAFE = ":/?#[]@!$&'()*+,;=%-._~"


def write(table: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Archives from a chunk table; the manifest, written as a table: path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = press = None
        path, records, size = "", 0, 0
        running = hashlib.sha1()

        def manifest() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=MANIFEST.names)

        def put(data: bytes) -> None:
            nonlocal size
            if data:
                size += len(data)
                out.write(data)

        for batch in batches:
            page, url, sha, n, refers, last, number, data = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "sha", "n", "refers_to", "last", "chunk", "data")]
            for i in range(batch.num_rows):
                k, piece = number[i].as_py(), data[i].as_buffer()
                revisit = refers[i].as_py()
                if k == 0:
                    if out is not None and size >= roll:
                        yield manifest()
                        out = None
                    if out is None:
                        path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = open_file(path, "wb")
                    press, running = zlib.compressobj(1, wbits=31), hashlib.sha1()
                    head, http = header(page[i].as_py(), url[i].as_py(), sha[i].as_py(), n[i].as_py(), revisit)
                    put(press.compress(head + http))
                if piece is not None and piece.size:
                    running.update(piece)
                    put(press.compress(piece))
                if k == last[i].as_py():
                    if revisit is None and running.hexdigest() != sha[i].as_py():
                        raise ValueError(f"the chunks of page {page[i].as_py()} are not its payload")
                    put(press.compress(b"\r\n\r\n") + press.flush())
                    records += 1
        if out is not None:
            yield manifest()

    return cut(table.mapInArrow(run, MANIFEST), "manifest")


class Members:
    """The bytes of an archive's gzip members, in pieces."""

    def __init__(self, stream):
        self.stream, self.kept, self.plain = stream, b"", zlib.decompressobj(31)
        self.ended = False

    def more(self) -> bytes:
        while True:
            if self.plain.eof:
                self.kept, self.plain = self.plain.unused_data, zlib.decompressobj(31)
            raw = self.plain.unconsumed_tail or self.kept or self.stream.read(CHUNK)
            self.kept = b""
            if not raw:
                return b""
            if got := self.plain.decompress(raw, CHUNK):
                return got


def records(stream) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """Header fields, payload bytes read and their SHA-1, record after record."""
    source, held = Members(stream), b""

    def until(mark: bytes) -> bytes | None:
        nonlocal held
        while (at := held.find(mark)) < 0:
            if not (got := source.more()):
                return None
            held += got
        head, held = held[:at], held[at + len(mark) :]
        return head

    def take(n: int) -> Iterator[bytes]:
        nonlocal held
        while n:
            if not held:
                held = source.more()
                if not held:
                    raise EOFError("the archive ends inside a record")
            piece, held = held[:n], held[n:]
            n -= len(piece)
            yield piece

    while (head := until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines)
        left, running, size = int(fields["Content-Length"]), hashlib.sha1(), 0
        if fields["WARC-Type"] == "response":
            http = until(b"\r\n\r\n")
            left -= len(http) + 4
        for piece in take(left):
            running.update(piece)
            size += len(piece)
        for _ in take(4):
            pass
        yield fields, size, running.digest()


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the archives of the manifest; payloads are digested anew and compared with their headers."""

    def number(uri: str | None) -> int | None:
        name = (uri or "").removeprefix(f"<{ID}").removesuffix(">")
        return int(name) if name not in ("", "None") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list = []
                with open_file(path, "rb") as stream:
                    for fields, size, digest in records(stream):
                        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and said != b32(digest):
                            raise ValueError(f"{fields['WARC-Record-ID']} does not match its digest")
                        rows.append((number(fields["WARC-Record-ID"]), size if kind == "response" else int(fields["X-Payload-Length"]), said, kind, number(fields.get("WARC-Refers-To"))))
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(2 * n, "path").mapInArrow(run, RECORDS)


def _rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=RECORDS.names)


def archive(spark: SparkSession, pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the archives of `pages` and gives their manifest."""
    return write(chunks(pages, roles(pages, least)), folder or fresh_path(spark, "warc"))
