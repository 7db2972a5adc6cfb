"""WARC records in ZIP-packaged archives, read by ranges.

An archive is a ZIP file with two stored (uncompressed) members: ``DATA``, WARC
records gzipped one by one, and ``INDEX``, a line of JSON per record with its
offset and length in ``DATA``. Nothing is ever extracted: a reader takes the end
of the file, finds the central directory (ZIP64 or not), the members in it and
the place of their bytes behind their local headers, then reads the index and,
by byte ranges, records.

Writing: each task streams its rows into archives of about ``ARCHIVE_BYTES`` in
the shared folder, under names of its own attempt; which archives count is what
the tasks return and Spark commits with the manifest, so archives of failed or
repeated attempts are never read.

Files are reached through ``pyarrow.fs`` by URI, so archives can lie on any file
system that it knows and all executors share.

Defined results: a null payload is empty; null or repeated ids are kept as they
are (records are named by their row's place in the input); an empty table makes
no archive.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import scratch_path

from .common import col, ready, row_keys, steps, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 64 << 20
#: Payloads below this length are never replaced by a revisit.
LEAST_REVISIT = 100
#: Bytes that a reading task takes at a time, from neighbouring records of an archive.
RANGE_BYTES = 4 << 20

# Fixed values of the ZIP format: signatures and the sizes of the fixed parts.
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_END_SIZE, _END64_SIZE, _LOCATOR64_SIZE, _ENTRY_SIZE, _LOCAL_SIZE = 22, 56, 20, 46, 30
_MOST_COMMENT = 0xFFFF
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


def members(f, size: int) -> list[Member]:
    """The central directory of a ZIP file open for random access."""
    tail_at = max(0, size - _END_SIZE - _MOST_COMMENT - _LOCATOR64_SIZE)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(_END)
    while at >= 0 and at + _END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = at - _LOCATOR64_SIZE
    if locator >= 0 and tail[locator:locator + 4] == _LOCATOR64:
        (end64,) = struct.unpack_from("<Q", tail, locator + 8)
        record = f.read_at(_END64_SIZE, end64)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory where its locator points")
        entries, length, start = struct.unpack_from("<QQQ", record, 32)
    return list(_entries(f.read_at(length, start), entries))


def _entries(directory: bytes, n: int) -> Iterator[Member]:
    at = 0
    for _ in range(n):
        if directory[at:at + 4] != _ENTRY:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        stored, size, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        at += _ENTRY_SIZE
        name = directory[at:at + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + name_size:at + name_size + extra_size]
        at += name_size + extra_size + comment_size
        wide = _zip64(extra)
        if size == 0xFFFFFFFF:
            size, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
        if stored == 0xFFFFFFFF:
            stored, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
        if header == 0xFFFFFFFF:
            header = struct.unpack_from("<Q", wide)[0]
        yield Member(name, method, size, stored, header)


def _zip64(extra: bytes) -> bytes:
    """The ZIP64 field of an entry's extra fields."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return extra[at + 4:at + 4 + size]
        at += 4 + size
    return b""


def member_start(f, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method != 0:
        raise ValueError(f"{m.name} is compressed, so it can't be read by ranges")
    local = f.read_at(_LOCAL_SIZE, m.header)
    if local[:4] != _LOCAL:
        raise ValueError("damaged local header")
    name_size, extra_size = struct.unpack_from("<HH", local, 26)
    return m.header + _LOCAL_SIZE + name_size + extra_size


def warc_record(headers: dict[str, str], body: bytes) -> bytes:
    """One gzipped WARC record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(body)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one gzipped WARC record; the body is whole or an error is raised."""
    plain = zlib.decompress(raw, 31)
    end = plain.index(b"\r\n\r\n")
    version, *lines = plain[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    length = int(headers["Content-Length"])
    body = plain[end + 4:end + 4 + length]
    if len(body) != length:
        raise ValueError("short WARC record")
    return headers, body


class _Archive:
    """An archive being written as a stream."""

    def __init__(self, folder: str):
        where, base = _place(folder)
        where.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.uri = f"{folder.rstrip('/')}/{name}"
        self.stream = where.open_output_stream(f"{base.rstrip('/')}/{name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, record: bytes, key: dict) -> None:
        self.data.write(record)
        self.index.append(json.dumps(key | {"offset": self.at, "length": len(record)}))
        self.at += len(record)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.index)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for b in steps(batches, "payload"):
            for r in b.to_pylist():
                archive = archive or _Archive(folder)
                full = r["payload"] or b""
                headers = {"WARC-Type": r["record_type"], "WARC-Record-ID": f"<urn:record:{r['record']}>",
                           "WARC-Target-URI": (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A"),
                           "WARC-Payload-Digest": f"sha256:{r['digest']}"}
                if r["id"] is not None:
                    headers["X-Id"] = str(r["id"])
                if r["record_type"] == "revisit":
                    headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<urn:record:{r['refers_record']}>"}
                    if r["refers_to"] is not None:
                        headers["X-Refers-To-Id"] = str(r["refers_to"])
                    full = b""
                archive.add(warc_record(headers, full), {"record": r["record"], "type": r["record_type"]})
                if archive.at >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                                         ["archive", "n_records"])

    return run


def with_record_types(records: DataFrame) -> DataFrame:
    """``records`` (id, url, payload) plus record, digest, record_type, refers_to (an id) and refers_record.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the row with the smallest id (the first of several; null ids
    come last) is a response and the others revisit it.
    """
    rows = row_keys(records, ["id", "url", F.coalesce("payload", F.lit(b"")).alias("payload")])
    name = F.concat_ws("-", "_file", "_row")
    narrow = (rows.select("id", name.alias("record"), F.sha2("payload", 256).alias("digest"), F.length("payload").alias("size"))
              .where(F.col("size") >= LEAST_REVISIT))
    first = (narrow.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "record")).alias("first"),
                                          F.count("*").alias("n")).where("n > 1").drop("n"))
    revisits = (narrow.join(first, "digest").where(F.col("record") != F.col("first.record"))
                .select("record", F.col("first.id").alias("refers_to"), F.col("first.record").alias("refers_record")))
    return (rows.withColumn("record", name).drop("_file", "_row").withColumn("digest", F.sha2("payload", 256))
            .join(revisits, "record", "left")
            .withColumn("record_type", F.when(F.col("refers_record").isNotNull(), "revisit").otherwise("response")))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (as from ``with_record_types``) and return the manifest: archive, n_records."""
    ready(records.sparkSession)
    rows = records.select("record", F.col("id").cast("string").alias("id"), F.col("url").cast("string").alias("url"), "payload",
                          "digest", "record_type", F.col("refers_to").cast("string").alias("refers_to"), "refers_record")
    return written(rows.mapInArrow(_write(folder), "archive string, n_records long"), "manifest")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring records of about ``RANGE_BYTES``, from the archives' indexes."""
    for b in batches:
        for uri in col(b, "archive").to_pylist():
            where, path = _place(uri)
            with where.open_input_file(path) as f:
                found = {m.name: m for m in members(f, f.size())}
                start = member_start(f, found[DATA])
                index = f.read_at(found[INDEX].size, member_start(f, found[INDEX])).decode()
            runs: list[list[tuple[int, int]]] = []
            for line in index.split("\n"):
                e = json.loads(line)
                if not runs or runs[-1][-1][0] + runs[-1][-1][1] - runs[-1][0][0] >= RANGE_BYTES:
                    runs.append([])
                runs[-1].append((start + e["offset"], e["length"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri] * len(runs), pa.string()), pa.array([r[0][0] for r in runs], pa.int64()),
                 pa.array([[n for _, n in r] for r in runs], pa.list_(pa.int64()))], ["archive", "start", "lengths"])


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                where, path = _place(r["archive"])
                with where.open_input_file(path) as f:
                    raw = f.read_at(sum(r["lengths"]), r["start"])
                at, out = 0, []
                for n in r["lengths"]:
                    headers, body = parse_record(raw[at:at + n])
                    at += n
                    out.append({"record": headers["WARC-Record-ID"], "id": headers.get("X-Id"), "record_type": headers["WARC-Type"], "url": headers["WARC-Target-URI"],
                                "refers_to": headers.get("X-Refers-To-Id"), "refers_record": headers.get("WARC-Refers-To"),
                                "declared": headers["WARC-Payload-Digest"].removeprefix("sha256:"),
                                "digest": hashlib.sha256(body).hexdigest(), "payload_bytes": len(body),
                                "payload": body if with_payload else None})
                yield pa.RecordBatch.from_pylist(out, schema=_RECORD)

    return run


_RECORD = pa.schema([("record", pa.string()), ("id", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
                     ("refers_to", pa.string()), ("refers_record", pa.string()),
                     ("declared", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives that ``manifest`` lists: record (its name), id, record_type, url, refers_to (an id),
    refers_record (a name), declared (the digest its header names), digest and payload_bytes (of its own body) and, if asked for, payload."""
    ready(manifest.sparkSession)
    ranges = written(manifest.select("archive").repartition("archive").mapInArrow(
        _ranges, "archive string, start long, lengths array<long>"), "ranges")
    kind = ("record string, id string, record_type string, url string, refers_to string, refers_record string, declared string, digest string, "
            "payload_bytes long, payload binary")
    return ranges.repartition("archive", "start").mapInArrow(_read(with_payload), kind)


def resolved(records: DataFrame) -> DataFrame:
    """``read_archives`` rows with digest and payload_bytes of the full payload: a revisit's are those of the record
    that it refers to, whose digest must be the one the revisit declares."""
    full = records.where("record_type = 'response'").select(
        F.col("record").alias("refers_record"), F.col("digest").alias("declared"), F.col("payload_bytes").alias("full_bytes"))
    joined = records.join(full, ["refers_record", "declared"], "left")
    revisit = F.col("record_type") == "revisit"
    return joined.withColumns({
        "payload_bytes": F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")),
        "digest": F.when(revisit & F.col("full_bytes").isNotNull(), F.col("declared")).otherwise(
            F.when(~revisit, F.col("digest")))}).drop("full_bytes")


def shared_folder(spark: SparkSession) -> str:
    """A new folder for archives in the cluster's shared one."""
    return scratch_path(spark, f"llm-archives-{uuid.uuid4().hex}")
