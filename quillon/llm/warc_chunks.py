"""WARC archives as a table of chunks: written and read as streams, never as whole records."""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tables import written
from quillon.session import scratch

#: Payload bytes in one chunk row.
CHUNK_BYTES = 64 * 1024
#: What stands before the payload in the block of every record.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Bytes of chunks that leave a task together.
BATCH_BYTES = 4 << 20
#: Payloads below this many bytes are never revisits.
MIN_REVISIT_BYTES = 100

CHUNKS = ("page_id long, record_id string, record_type string, refers_to long, chunk_no long, chunk binary, "
          "digest_so_far string, payload_bytes long, payload_digest string")


def open_out(uri: str):
    """A byte stream into a file of any store that pyarrow knows; the folder is made if need be."""
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_in(uri: str):
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression=None)


def as_uri(path: str) -> str:
    return path if re.match(r"[a-z0-9]+:", path) else f"file://{path}"


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, payload_digest, payload_bytes, record_type, refers_to, copies`` of each distinct (page_id, payload).

    Of equal payloads of ``min_bytes`` and more the smallest page_id (nulls last) is the response and the others
    revisit it. Null html is the empty payload. Equal rows are one record with ``copies`` rows.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    each = pages.select("page_id", F.sha2(payload, 256).alias("payload_digest"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"))
    each = each.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.count("*").alias("copies"))
    first = (each.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) \
        & (F.col("payload_bytes") >= min_bytes)
    return each.join(first, "payload_digest", "left").select(
        "page_id", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"), "copies")


def chunk_rows(pages: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """``page_id, url, payload_digest, chunk_no, chunk`` of every page: rows of at most ``size`` bytes; an empty payload
    has one empty chunk. A payload is read once from end to end, and chunks leave in batches of bounded size."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_digest": pa.string(), "chunk_no": pa.int64(), "chunk": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for page, url, payload in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("payload")):
                data = memoryview(payload.as_buffer())
                digest = hashlib.sha256(data).hexdigest()
                for number, at in enumerate(range(0, max(1, len(data)), size)):
                    rows.append((page, url, digest, number, data[at:at + size].tobytes()))
                    held += min(size, len(data) - at)
                    if held >= BATCH_BYTES or len(rows) >= 10_000:
                        yield table(rows, kinds)
                        rows, held = [], 0
        if rows:
            yield table(rows, kinds)

    payload = F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    return pages.select("page_id", "url", payload).mapInArrow(
        run, "page_id long, url string, payload_digest string, chunk_no long, chunk binary")


def table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


class Member:
    """One gzip member of an archive, written as it comes."""

    def __init__(self, out):
        self.out, self.packer = out, zlib.compressobj(1, wbits=31)

    def write(self, data: bytes) -> None:
        self.out.write(self.packer.compress(data))

    def close(self) -> None:
        self.out.write(self.packer.flush())


def record_id(page: int | None, digest: str) -> str:
    """The identifier of the record of a page and payload; revisits name their response by it."""
    return f"urn:page:{'' if page is None else page}:{digest}"


def header(row: dict) -> bytes:
    """The header block of a record and the HTTP head that its block begins with; header values hold no line ends."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "")
    revisit = row["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>",
             f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
             "Content-Type: application/http; msgtype=response",
             f"X-Page-ID: {'' if row['page_id'] is None else row['page_id']}",
             f"X-Payload-Length: {row['payload_bytes']}",
             f"Content-Length: {len(HTTP_HEAD) + (0 if revisit else row['payload_bytes'])}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{record_id(row['refers_to'], row['payload_digest'])}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + HTTP_HEAD


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as gzipped WARC files below ``folder``; returns ``path, n_records`` of the files that count.

    Chunk rows meet the decision on their record in one join by page and come in order, so a task holds one batch of
    chunks. Each attempt of a task writes a file of its own name, and only files of attempts that succeeded are
    listed; a retry leaves at most an unlisted file.
    """
    todo = records(pages).drop("copies")
    both = chunk_rows(pages).alias("c").join(
        todo.alias("t"), F.col("c.page_id").eqNullSafe(F.col("t.page_id"))
        & (F.col("c.payload_digest") == F.col("t.payload_digest"))).select(
        "c.page_id", "c.url", "c.payload_digest", "c.chunk_no", "t.record_type", "t.refers_to", "t.payload_bytes",
        F.when((F.col("t.record_type") == "response") | (F.col("c.chunk_no") == 0), F.col("c.chunk")).alias("chunk"))
    rows = both.where(F.col("chunk").isNotNull()).sortWithinPartitions("payload_digest", "page_id", "chunk_no", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, out, member, at, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, None, None, 0, 0
        for batch in batches:
            for row in batch.to_dict("records"):
                key = (row["page_id"] if pd.notna(row["page_id"]) else None, row["payload_digest"])
                if at is None or key != at[0]:
                    if member:
                        member.write(b"\r\n\r\n")
                        member.close()
                    out = out or open_out(path)
                    member, at, n = Member(out), (key, -1), n + 1
                    row |= {"page_id": key[0], "record_id": record_id(*key),
                            "refers_to": int(row["refers_to"]) if pd.notna(row["refers_to"]) else None}
                    member.write(header(row))
                if row["chunk_no"] > at[1]:  # repeated rows bring a chunk again
                    at = (key, row["chunk_no"])
                    if row["record_type"] == "response":
                        member.write(row["chunk"])
        if member:
            member.write(b"\r\n\r\n")
            member.close()
            size = out.tell()
            out.close()
            yield pd.DataFrame({"path": [path], "n_records": [n], "n_bytes": [size]})

    fixed = rows.withColumn("page_id", F.col("page_id").cast("string")) \
        .withColumn("refers_to", F.col("refers_to").cast("string"))
    return written(fixed.mapInPandas(run, "path string, n_records long, n_bytes long"), "warc-files")


class Unpacked(io.RawIOBase):
    """The plain bytes of a file of gzip members, unpacked a little at a time."""

    def __init__(self, source):
        self.source, self.unpacker, self.packed = source, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.unpacker.eof:
                self.packed = self.unpacker.unused_data or self.packed
                self.unpacker = zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.source.read(1 << 16)
                if not self.packed:
                    return 0
            plain = self.unpacker.decompress(self.packed, len(buffer))
            self.packed = b"" if self.unpacker.eof else self.unpacker.unconsumed_tail
            if plain:
                buffer[:len(plain)] = plain
                return len(plain)


def read_chunks(path: str, size: int = CHUNK_BYTES) -> Iterator[tuple]:
    """The chunk rows of one archive, in order: fields as in ``CHUNKS``.

    ``digest_so_far`` is the digest of the payload up to and with the chunk; the last chunk of a record, and only
    that, has ``payload_bytes`` and ``payload_digest``. A digest or length unlike the header's raises.
    """
    with open_in(path) as source:
        stream = io.BufferedReader(Unpacked(source), 1 << 17)
        while line := stream.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: not a WARC record")
            fields = {}
            while (line := stream.readline()) != b"\r\n":
                name, _, value = line.decode().partition(":")
                fields[name] = value.strip()
            page = int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None
            record = fields["WARC-Record-ID"][1:-1]
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].partition(":")[2]
            left, n, seen, running = int(fields["Content-Length"]), 0, 0, hashlib.sha256()
            if stream.read(len(HTTP_HEAD)) != HTTP_HEAD:
                raise ValueError(f"{path}: {record} has no HTTP head")
            left -= len(HTTP_HEAD)
            if kind == "revisit":
                refers_to = fields["WARC-Refers-To"].split(":")[2]
                yield (page, record, kind, int(refers_to), 0, b"", None,
                       int(fields["X-Payload-Length"]), digest)
            while kind != "revisit":
                chunk = stream.read(min(size, left))
                running.update(chunk)
                left, seen = left - len(chunk), seen + len(chunk)
                if left and not chunk:
                    raise ValueError(f"{path}: {record} ends early")
                so_far = running.hexdigest()
                if not left and (so_far != digest or seen != int(fields["X-Payload-Length"])):
                    raise ValueError(f"{path}: {record} is damaged")
                yield (page, record, kind, None, n, chunk, so_far, None if left else seen, None if left else so_far)
                n += 1
                if not left:
                    break
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: {record} has no end")


def read_archives(files: DataFrame, with_payload: bool = True, rows_per_batch: int = 64) -> DataFrame:
    """The chunk table of the files that ``files`` lists, a file per task at a time.

    ``with_payload=False`` still reads and digests every byte but leaves ``chunk`` null and keeps only the rows that
    end a record.
    """

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = {c.split()[0]: kinds[c.split()[1]] for c in CHUNKS.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            rows = []
            for row in read_chunks(path):
                if with_payload or row[8] is not None:
                    rows.append(row if with_payload else (*row[:5], None, *row[6:]))
                if len(rows) >= (rows_per_batch if with_payload else 10_000):
                    yield table(rows, columns)
                    rows = []
            if rows:
                yield table(rows, columns)

    spread = files.select("path").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives, read them back, and return a row per page with what the archives say.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``; a page that is in the table twice has two
    rows, and one with several payloads a record for each. Null html is the empty payload; a null page_id is never what
    others refer to. An empty table writes nothing and has no rows; other columns are ignored. ``folder`` (default: a new one in the shared folder) must be reachable by every executor.
    """
    folder = as_uri(folder or scratch(pages.sparkSession, "warc"))
    files = write_archives(pages, folder)
    ends = read_archives(files, with_payload=False).where(F.col("payload_digest").isNotNull())
    copies = records(pages).where("copies > 1").select("page_id", "payload_digest", "copies")
    both = ends.alias("e").join(copies.alias("c"), F.col("e.page_id").eqNullSafe(F.col("c.page_id"))
                                & (F.col("e.payload_digest") == F.col("c.payload_digest")), "left")
    return both.select("e.page_id", "payload_bytes", F.col("e.payload_digest").alias("payload_digest"), "record_type",
                       "refers_to", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("copies").cast("int"), F.lit(1)))
                                              ).alias("_copy")).drop("_copy")
