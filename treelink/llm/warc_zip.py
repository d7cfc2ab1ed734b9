"""WARC records in ZIP packages: a writer, and a reader that parses the central directory (ZIP64 too) and range-reads records in place.

An archive holds stored members: WARC files and, for each, an index of lines "offset length page_id". The reader fetches the end of
the archive, the directory and the indexes, deals out ranges of records, and reads only these. Nothing is extracted to disk.
Tasks open archives with pyarrow's file systems (local, HDFS, S3, GCS, Azure); other stores are not reached.

Defined results: a null html is an empty payload; repeated rows of the smallest page_id with a payload are all responses; a null
page_id ranks after all others; line breaks and other control characters of a url are percent-encoded in its record; an empty table
gives an empty archive set and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

#: Bytes of records in one archive before the next one begins, and in one range of records that a task reads.
ARCHIVE_BYTES, RANGE_BYTES = 128 << 20, 8 << 20
# Signatures and sizes of ZIP structures.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a uri as Spark writes it: s3a and s3n are what pyarrow calls s3, abfss what it calls abfs."""
    scheme, colon, rest = uri.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme)
    return pafs.FileSystem.from_uri(scheme + colon + ("//" if scheme == "file" and not rest.startswith("//") else "") + rest)


def header_value(text: str) -> str:
    """Control characters would end or split a header line, so they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the headers of the payload, whose length they state, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {header_value(url)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of its HTTP part and what follows them."""

    def fields(part: bytes) -> dict[str, str]:
        pairs = (line.split(":", 1) for line in part.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ":" in line)
        return {k.strip().lower(): v.strip() for k, v in pairs}

    head, rest = data.split(b"\r\n\r\n", 1)
    warc = fields(head)
    http, payload = rest[: int(warc["content-length"])].split(b"\r\n\r\n", 1)
    return warc, fields(http), payload


def directory(size: int, read) -> list[tuple[str, int, int]]:
    """(name, offset of its bytes, length) of each stored member; read(offset, length) fetches a range."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack("<H", tail[end + 20 : end + 22])[0] != len(tail)):
        end = tail.rfind(END, 0, end)  # these bytes stand in the archive's comment
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF == n or 0xFFFFFFFF in (length, start):
        at = end - 20
        if at < 0 or tail[at : at + 4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        where = struct.unpack("<Q", tail[at + 8 : at + 16])[0]
        big = read(where, 56)
        if big[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack("<QQQ", big[32:56])
    d, at, out = read(start, length), 0, []
    for _ in range(n):
        if d[at : at + 4] != ENTRY:
            raise ValueError("damaged central directory")
        method, packed, plain = struct.unpack("<H", d[at + 10 : at + 12])[0], *struct.unpack("<II", d[at + 20 : at + 28])
        name_n, extra_n, note_n = struct.unpack("<HHH", d[at + 28 : at + 34])
        local = struct.unpack("<I", d[at + 42 : at + 46])[0]
        name = d[at + 46 : at + 46 + name_n].decode("utf-8")
        extra, e = d[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while e + 4 <= len(extra):
            kind, m = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:  # in this order, and only those that don't fit above
                wide = iter(struct.unpack(f"<{m // 8}Q", extra[e + 4 : e + 4 + m // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            e += 4 + m
        if method != 0 or packed != plain:
            raise ValueError(f"{name} is not stored")
        head = read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        skip = 30 + sum(struct.unpack("<HH", head[26:30]))
        out.append((name, local + skip, packed))
        at += 46 + name_n + extra_n + note_n
    return out


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, payload, digest, refers_to as archives in folder; returns the paths that finished tasks wrote.

    A task that is run again writes files of other names, and only the paths it returns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name, out, z, warc, index, at = "", None, None, None, [], 0

        def end() -> pa.RecordBatch:
            warc.close()
            z.writestr("records.idx", "".join(index))
            z.close()
            out.close()
            return pa.record_batch({"path": [f"{folder}/{name}"]})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c for c in batch.columns), strict=True):
                if z is None:
                    name, index, at = f"{uuid.uuid4().hex}.wacz", [], 0
                    out = fs.open_output_stream(f"{base}/{name}")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    warc = z.open("records.warc", "w", force_zip64=True)
                data = record(page_id.as_py(), url.as_py() or "", payload.as_py(), digest.as_py(), refers_to.as_py())
                warc.write(data)
                index.append(f"{at} {len(data)} {page_id.as_py()}\n")
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    yield end()
                    z = None
        if z is not None:
            yield end()

    return pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string")


def read_archives(paths: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, payload: one row per record of the archives in column path.

    Payloads are those that records hold; a revisit has none, and its length and digest are as its headers state.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = _open(path)
                with fs.open_input_file(inner) as f:
                    read = lambda at, n: f.read_at(n, at)
                    members = {name: (at, n) for name, at, n in directory(f.size(), read)}
                    for name, (at, n) in members.items():
                        if not name.endswith(".idx"):
                            continue
                        base = members[name[:-4] + ".warc"][0]
                        offsets, lengths, held = [], [], 0
                        for line in bytes(read(at, n)).decode().splitlines():
                            offset, length = map(int, line.split()[:2])
                            offsets.append(base + offset)
                            lengths.append(length)
                            held += length
                            if held >= RANGE_BYTES:
                                yield pa.record_batch({"path": [path], "offsets": pa.array([offsets], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64()))})
                                offsets, lengths, held = [], [], 0
                        if offsets:
                            yield pa.record_batch({"path": [path], "offsets": pa.array([offsets], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, inner = _open(row["path"])
                out = []
                with fs.open_input_file(inner) as f:
                    for at, n in zip(row["offsets"], row["lengths"], strict=True):
                        warc, http, payload = parse_record(bytes(f.read_at(n, at)))
                        number = lambda s: int(x) if (x := s.rstrip(">").rsplit(":", 1)[1]) else None
                        full = warc["warc-type"] == "response"
                        digest = sha1_base32(payload) if full else warc["warc-payload-digest"].removeprefix("sha1:")
                        size = len(payload) if full else int(http["content-length"])
                        out.append((number(warc["warc-record-id"]), warc["warc-type"], number(warc["warc-refers-to"]) if "warc-refers-to" in warc else None, size, digest, payload if full else None))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    spark = paths.sparkSession
    spread = Scratch(spark, "warc-ranges").save(paths.mapInArrow(ranges, "path string, offsets array<long>, lengths array<long>"), "ranges")
    n = spread.count()
    # Ranges are few and narrow rows, which adaptive execution would put into one task; a stated number of tasks is kept.
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-n // 16))))
    return spread.repartition(tasks).mapInArrow(records, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to for pages with page_id, url, html: the first page of equal payloads is what the others refer to.

    Only page_id, digest and length are shuffled; the repeated keys come back by a broadcast if their counted size allows it.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([sha1_base32(x.as_py()) for x in b.column("payload")], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "digest"])

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.mapInArrow(digests, "page_id long, url string, payload binary, digest string").withColumn("bytes", F.length("payload"))
    first = p.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1").select("digest", "bytes", "first")
    first = Scratch(pages.sparkSession, "warc-first").save(first, "first")
    out = p.join(broadcast_if_small(first, first.count(), 80), ["digest", "bytes"], "left")
    return out.select("page_id", "url", "payload", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder, and read them back."""
    scratch = Scratch(spark, "warc")
    paths = scratch.save(write_archives(with_revisits(pages), scratch.path("archives")), "paths")
    return read_archives(paths)
