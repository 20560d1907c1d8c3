"""Web archives (WARC 1.1, one gzip member a record) written and read as a table of payload chunks.

A payload travels as rows (record, chunk number, bytes) in order, so neither the writer nor the reader
holds a whole record: the writer streams each chunk into the open gzip member, the reader takes fixed
pieces out of it and carries the digest along. Files have unique names; only those named in the settled
manifest count, so the leavings of a lost or repeated task are never read.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_dir

CHUNK = 64 << 10
FILE_BYTES = 64 << 20
MIN_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
CHUNK_SCHEMA = ("page_id long, record_id string, record_type string, target_uri string, refers_to long, chunk_no long, "
                "data binary, bytes_so_far long, digest_so_far string, last boolean, intact boolean")


def record_chunks(pages: DataFrame, min_revisit: int = MIN_REVISIT, chunk: int = CHUNK) -> DataFrame:
    """Rows (page_id, url, record_type, refers_to, digest, payload_bytes, chunk_no, last, data) of all pages.

    Of payloads that are equal and at least `min_revisit` bytes long, the one with the largest page_id is the
    response and the others refer to it; rows tied on that id are all responses. Groups are counted by
    digest and length before payloads move.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(payload).alias("digest"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), payload.alias("payload"))
    slim = rows.select("page_id", "digest", "payload_bytes").filter(F.col("payload_bytes") >= min_revisit)
    groups = settle(slim.groupBy("digest", "payload_bytes")
                    .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
                    .filter("n > 1 AND keeper IS NOT NULL").drop("n"))
    typed = rows.join(groups, ["digest", "payload_bytes"], "left")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    typed = typed.select("page_id", "url", "digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("keeper")).alias("refers_to"),
                         F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("int")
    return (typed.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
            .select("page_id", "url", "record_type", "refers_to", "digest", "payload_bytes", "chunk_no",
                    (F.col("chunk_no") == n - 1).alias("last"),
                    F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data")))


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'sha1:{digest}')}"


def head(row: dict) -> bytes:
    """WARC and HTTP headers of a record. The HTTP length is that of the full payload, also for a revisit."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['payload_bytes']}\r\n\r\n").encode()
    revisit = row["record_type"] == "revisit"
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{record_id(row['page_id'], row['digest'])}>"),
              ("WARC-Date", DATE)]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", "".join(row["url"].split())))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(row['refers_to'], row['digest'])}>"),
                   ("X-Refers-To-Page", str(row["refers_to"]))]
    if row["page_id"] is not None:
        fields.append(("X-Page", str(row["page_id"])))
    fields += [("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(http) + (0 if revisit else row["payload_bytes"])))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + http


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        sink, name, size, records, done = None, "", 0, 0, []
        pack = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if row["chunk_no"] == 0:
                    if sink is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        sink, size, records = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    size += sink.write(pack.compress(head(row)))
                size += sink.write(pack.compress(row["data"]))
                if row["last"]:
                    size += sink.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    records += 1
                    if size >= file_bytes:
                        sink.close()
                        done.append((f"{folder}/{name}", records, size))
                        sink = None
        if sink is not None:
            sink.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])
    return run


def write_archives(chunks: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the chunk rows to WARC files in a shared folder; the settled manifest: path, records, bytes.

    Chunks of a record must follow each other in their partition, as record_chunks leaves them. A file is
    closed at the first record end beyond `file_bytes`.
    """
    return settle(chunks.mapInArrow(_write(folder, file_bytes), "path string, records long, bytes long"))


class Members:
    """Reads the gzip members of a stream one after the other, with bounded memory."""

    def __init__(self, source, piece: int = CHUNK):
        self.source, self.piece, self.raw, self.buffer, self.unzip = source, piece, b"", b"", None

    def open(self) -> bool:
        self.raw = self.raw or self.source.read(self.piece)
        self.unzip, self.buffer = zlib.decompressobj(31), b""
        return bool(self.raw)

    def fill(self) -> bool:
        """Adds some bytes of the member to the buffer; false at the member's end."""
        while not self.unzip.eof:
            self.raw = self.raw or self.source.read(self.piece)
            if not self.raw:
                raise EOFError("archive ends within a record")
            found = self.unzip.decompress(self.raw, self.piece)
            self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if found:
                self.buffer += found
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while mark not in self.buffer:
            if not self.fill():
                raise EOFError("header without end")
        found, _, self.buffer = self.buffer.partition(mark)
        return found

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.fill():
            pass
        found, self.buffer = self.buffer[:n], self.buffer[n:]
        return found


def fields_of(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in
            (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def records(source, piece: int = CHUNK) -> Iterator[tuple]:
    """The chunk rows of one archive. Digest and length grow with the chunks; a revisit has one empty
    chunk with the digest and length that its headers state."""
    stream = Members(source, piece)
    while stream.open():
        warc = fields_of(stream.until(b"\r\n\r\n"))
        left = int(warc["content-length"])
        block = stream.until(b"\r\n\r\n")
        left -= len(block) + 4
        stated = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        length = int(fields_of(block)["content-length"])
        page, other = warc.get("x-page"), warc.get("x-refers-to-page")
        first = (int(page) if page else None, warc["warc-record-id"].strip("<>"), warc["warc-type"],
                 warc.get("warc-target-uri"), int(other) if other else None)
        if warc["warc-type"] == "revisit":
            yield (*first, 0, b"", length, stated, True, True)
        else:
            digest, seen, number = hashlib.sha1(), 0, 0
            while True:
                data = stream.take(min(piece, left - seen))
                digest.update(data)
                seen += len(data)
                last = seen >= left or not data
                yield (*first, number, data, seen, digest.hexdigest(), last,
                       not last or (digest.hexdigest() == stated and seen == length))
                number += 1
                if last:
                    break
        while stream.fill():
            stream.buffer = b""


def _read(piece: int):
    names = [part.split()[0] for part in CHUNK_SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[part.split()[1]]
             for part in CHUNK_SCHEMA.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(place, compression=None) as source:
                    for row in records(source, piece):
                        rows.append(row)
                        held += len(row[6]) + 200
                        if held > 4 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)
    return run


def read_archives(manifest: DataFrame, piece: int = CHUNK) -> DataFrame:
    """The chunk table of all archives of a manifest, files spread over the session's shuffle partitions."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(_read(piece), CHUNK_SCHEMA)


def archive_round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes a record for each page, reads the archives back and returns for each page: page_id,
    payload_bytes, payload_digest (hex SHA-1), record_type, refers_to, intact.

    Null payloads are empty. A page without page_id is archived under its digest and refers to the others
    of its payload. Repeated rows give a record each. White space is taken out of URLs, a null URL is left
    out. Without pages there is no archive and no row. Needs a shared folder that pyarrow can open.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(record_chunks(pages, min_revisit), folder)
    return (read_archives(manifest).filter("last")
            .select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"),
                    "record_type", "refers_to", "intact"))
