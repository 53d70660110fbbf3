"""Deterministic sharded WARC writer and reader.

Pages are cut into contiguous ranges of page_id by minimax over their bytes, sorted within each range, and written as
gzip members, one per record, into files that roll by compressed size. Digests and headers are made anew from the
payload. Equal payloads are found on narrow rows; what a page refers to joins its record as a note row in the same
sort, so the payloads move once. Each task attempt writes under temporary names of its own and returns manifest rows;
only files whose rows Spark kept are renamed, and the manifest table, written last, is the commit.

Defined results: a null payload is empty; of equal payloads the largest page_id is the response, a null id only if
there is no other; of repeated rows with that id the first is the response and the rest revisit it; an empty table
gives an empty manifest and no files. The bytes depend on the rows alone, not on partitions or attempts.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sharding
from ._util import materialize, schema_with, small_batches

#: Payload bytes of one range of pages, the fewest ranges, and the compressed size at which a file is closed.
RANGE_BYTES, LEAST_RANGES, FILE_BYTES = 256 << 20, 64, 64 << 20
#: Tasks that rename or read files at most.
MOST_TASKS = 10_000
DATE = "2000-01-01T00:00:00Z"
NAMES = uuid.UUID("6d1c0f4a-5a0e-4c55-8f0e-0a6b8e1f7a10")
MANIFEST = "slice int, seq int, temporary string, file string, bytes long, records long, sha256 string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member that holds a WARC record; the same input gives the same bytes."""
    ends = [("WARC-Date", DATE), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, *ends])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page: str | None, url: str | None, payload: bytes, nth: int, refers: tuple[str | None] | None) -> bytes:
    """The record of a page; refers holds the id of the response that it revisits, or is None."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}|{digest}|{nth}')}>"), ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        headers.append(("X-Page-Id", quote(page)))
    if refers is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(NAMES, f'{refers[0]}|{digest}|0')}>")]
    if refers[0] is not None:
        headers.append(("X-Refers-To-Page-Id", quote(refers[0])))
    return record("revisit", headers, http)


class Roller:
    """Open file of one range: closes at the size limit, counts and digests what it writes."""

    def __init__(self, root: str, limit: int):
        self.files, self.path = fs.FileSystem.from_uri(root)
        self.limit, self.attempt, self.out, self.done = limit, uuid.uuid4().hex, None, []

    def write(self, at: int, data: bytes) -> None:
        if self.out is not None and (at != self.slice or self.bytes >= self.limit):
            self.close()
        if self.out is None:
            self.seq = self.done[-1][1] + 1 if self.done and self.done[-1][0] == at else 0
            self.slice, self.bytes, self.records, self.digest = at, 0, 0, hashlib.sha256()
            self.name = f"pages-{at:06d}-{self.seq:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{self.name}"
            self.out = self.files.open_output_stream(posixpath.join(self.path, self.temporary), compression=None)
            self._put(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, self.name)}>"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.slice, self.seq, self.temporary, self.name, self.bytes, self.records, self.digest.hexdigest()))
            self.out = None


def tasks_for(manifest: DataFrame) -> int:
    """One task for each file of a manifest, up to a bound beyond which a task takes several."""
    return max(1, min(manifest.count(), MOST_TASKS))


def sliced(rows: DataFrame, keys: list[int]) -> DataFrame:
    """Adds the range of each page_id; the bounds are an array in the closure, one long per range."""
    bounds = np.array([k for k in keys if k < 1 << 63], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("key").to_numpy()
            at = np.searchsorted(bounds, ids, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "slice"])

    return rows.mapInArrow(run, schema_with(rows, rows.columns, "slice int"))


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write the archives under root, a URI that all executors share, and return the committed manifest.

    Ids of other types than integers are ordered by their hash. Other columns are not archived.
    """
    spark = pages.sparkSession
    small_batches(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(id_col)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(key.alias("key"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))

    narrow = materialize(rows.select("key", "id", "digest", F.octet_length("payload").alias("size")))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-total // range_bytes))
    _, keys = sharding.plan(materialize(narrow.groupBy("key").agg(F.sum(F.col("size") + 8).alias("bytes"))), ranges)
    first = narrow.groupBy("digest", "size").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    notes = narrow.join(first, ["digest", "size"]).select("key", "id", "digest", F.struct("first").alias("note")).distinct()
    note = notes.schema["note"].dataType
    both = rows.withColumn("note", F.lit(None).cast(note)).unionByName(notes, allowMissingColumns=True)
    both = both.withColumns({"id": F.col("id").cast("string"), "note": F.col("note").cast("struct<first: string>")})
    # Each range is a task of its own; hashing would put several into one.
    dealt = sliced(both, keys).repartitionById(ranges, "slice").sortWithinPartitions("slice", "key", "id", "digest", F.col("note").isNull(), "url")

    target, folder = fs.FileSystem.from_uri(root)
    target.create_dir(posixpath.join(folder, "_temporary"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, first, nth = Roller(root, file_bytes), None, None, 0
        for batch in batches:
            for at, page, url, data, digest, note in zip(*(batch.column(c).to_pylist() for c in ("slice", "id", "url", "payload", "digest", "note")), strict=True):
                if (page, digest) != last:
                    last, first, nth = (page, digest), None, 0
                if note is not None:
                    first = (note["first"],)
                    continue
                revisits = first is not None and (first[0] != page or nth > 0)
                roller.write(at, page_record(page, url, data, nth, first if revisits else None))
                nth += 1
        roller.close()
        yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, x, strict=True)) for x in roller.done], SCHEMA)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist(), strict=True):
                there = files.get_file_info(posixpath.join(folder, temporary))
                if there.type != fs.FileType.NotFound:  # else an earlier attempt has renamed it
                    files.move(there.path, posixpath.join(folder, name))
            yield batch

    written = materialize(dealt.mapInArrow(archive, MANIFEST))
    # A count that is given is kept by adaptive execution, so renames are spread too.
    written.repartition(tasks_for(written)).mapInArrow(rename, MANIFEST).write.parquet(f"{root}/manifest")
    target.delete_dir(posixpath.join(folder, "_temporary"))
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


SCHEMA = pa.schema([("slice", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])
FIELDS = SCHEMA.names


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked; holds one record at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last WARC record is incomplete")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"WARC record {headers.get('WARC-Record-ID')} is damaged")
    return headers, block


RECORDS = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """The page records of the files that the manifest lists; digests are checked on the way. Revisits have no payload."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")

    def rows(name: str) -> Iterator[dict]:
        files, folder = fs.FileSystem.from_uri(root)
        with files.open_input_stream(posixpath.join(folder, name), compression=None) as stream:
            for member in members(stream):
                headers, block = parse(member)
                if headers["WARC-Type"] == "warcinfo":
                    continue
                payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if payload is not None and base32_sha1(payload) != digest:
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                ids = {k: unquote(headers[h]) if h in headers else None for k, h in (("page_id", "X-Page-Id"), ("refers_to", "X-Refers-To-Page-Id"))}
                yield ids | {"url": headers["WARC-Target-URI"], "payload": payload if with_payload else None, "payload_bytes": int(headers["X-Payload-Length"]), "payload_digest": digest, "record_type": headers["WARC-Type"]}

    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(name):
                    held.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return manifest.select("file").repartition(tasks_for(manifest)).mapInArrow(run, RECORDS)
