import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.llm import zipwarc as Z

PAGES = "id long, url string, payload binary"
BIG, OTHER = b"x" * 150, b"y" * 99


def pages(spark):
    rows = [(5, "http://a/", BIG), (3, "http://b/", BIG), (3, None, BIG), (None, "u\r\nv", BIG), (1, "é", OTHER), (2, "z", OTHER),
            (7, "n", None), (8, "e", b""), (9, "l", b"0123456789" * 300_000), (10, "m", b"0123456789" * 300_000), (None, None, None)]
    df = spark.createDataFrame(rows, PAGES)
    return rows, df.withColumn("record", F.lit(1)).withColumn("digest", F.lit(2))


def round_trip(spark, df, scratch, with_payload=False):
    manifest = Z.write_archives(Z.with_record_types(df.select("id", "url", "payload")), f"{scratch}/archives")
    return manifest, Z.read_archives(manifest, with_payload)


@pytest.mark.parametrize("archive_bytes", [64 << 20, 1])
def test_round_trip(spark, scratch, monkeypatch, archive_bytes):
    monkeypatch.setattr(Z, "ARCHIVE_BYTES", archive_bytes)
    rows, df = pages(spark)
    manifest, read = round_trip(spark, df, scratch, with_payload=True)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    assert sorted(r.payload for r in read.where("record_type = 'response'").collect()) == sorted(
        [BIG, OTHER, OTHER, b"", b"", b"", b"0123456789" * 300_000])
    out = [(r.id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in Z.resolved(read).collect()]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = [("3", 150, digest(BIG), "response", None), *[(i, 150, digest(BIG), "revisit", "3") for i in ("3", "5", None)],
            *[(i, 99, digest(OTHER), "response", None) for i in ("1", "2")], *[(i, 0, digest(b""), "response", None) for i in ("7", "8", None)],
            ("9", 3_000_000, digest(b"0123456789" * 300_000), "response", None), ("10", 3_000_000, digest(b"0123456789" * 300_000), "revisit", "9")]
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert {r.url for r in read.collect()} >= {"u%0D%0Av", "é", ""}


def test_archives_are_plain_zip_files(spark, scratch):
    _, df = pages(spark)
    manifest, _ = round_trip(spark, df, scratch)
    for r in manifest.collect():
        where, path = Z._place(r.archive)
        with where.open_input_file(path) as f:
            raw = f.read()
        z = zipfile.ZipFile(io.BytesIO(raw))
        assert z.testzip() is None and z.namelist() == [Z.DATA, Z.INDEX]
        assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


class Ranges:
    """A file that only answers ranges, and counts the bytes asked for."""

    def __init__(self, raw):
        self.raw, self.read = raw, 0

    def read_at(self, n, at):
        self.read += n
        return self.raw[at:at + n]


def made(monkeypatch, wide, comment=b""):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for i in range(40):
            z.writestr(f"é{i}" if i % 2 else f"m{i}", bytes([i]) * (100_000 if i == 7 else i))
        z.writestr(zipfile.ZipInfo("deflated"), b"q" * 500, zipfile.ZIP_DEFLATED)
        z.comment = comment
    return raw.getvalue()


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 a comment that looks like an end"])
def test_directories_by_ranges(monkeypatch, wide, comment):
    raw = made(monkeypatch, wide, comment)
    assert (Z._END64 in raw) == wide
    f = Ranges(raw)
    found = {m.name: m for m in Z.members(f, len(raw))}
    assert len(found) == 41 and f.read < 80_000
    for i in (0, 1, 7, 39):
        m = found[f"é{i}" if i % 2 else f"m{i}"]
        start = Z.member_start(f, m)
        assert raw[start:start + m.size] == bytes([i]) * (100_000 if i == 7 else i)
    with pytest.raises(ValueError, match="compressed"):
        Z.member_start(f, found["deflated"])


def test_damage_is_an_error():
    with pytest.raises(ValueError, match="no end"):
        Z.members(Ranges(b"PK" + b"\0" * 200), 202)
    record = Z.warc_record({"WARC-Type": "response"}, b"body")
    assert Z.parse_record(record) == ({"WARC-Type": "response", "Content-Length": "4"}, b"body")
    with pytest.raises(Exception):
        Z.parse_record(record[:-9])


def test_orphaned_archives_are_not_read(spark, scratch):
    _, df = pages(spark)
    manifest, read = round_trip(spark, df, scratch)
    before = read.count()
    list(Z._write(f"{scratch}/archives")([Z.with_record_types(df.select("id", "url", "payload")).select(
        "record", F.col("id").cast("string").alias("id"), "url", "payload", "digest", "record_type",
        F.col("refers_to").cast("string").alias("refers_to"), "refers_record").toArrow().to_batches()[0]]))
    assert Z.read_archives(manifest).count() == before


def test_empty(spark, scratch):
    manifest, read = round_trip(spark, spark.createDataFrame([], PAGES), scratch)
    assert manifest.count() == 0 and read.count() == 0 and Z.resolved(read).count() == 0
