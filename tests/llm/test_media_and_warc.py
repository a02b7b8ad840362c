import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netquarry.llm import media, warc


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(data):
    blob = media.pack(data)
    (track,) = media.tracks(blob)
    payload = media.read_samples(blob, track)
    assert payload == data + bytes(-len(data) % 64 if data else 64)
    assert track["codec"] == "raw" and track["duration"] == len(payload) and track["timescale"] == 8000
    keys = track["offsets"][track["is_sync"]]
    assert len(keys) == -(-len(payload) // 1024) and blob[keys[-1]:keys[-1] + 64] == payload[1024 * (len(keys) - 1):][:64]


def test_reading_other_layouts():
    """Sample sizes that differ, two chunks out of order, 64-bit chunk offsets and box sizes, and no sync table."""
    sizes, chunks = [3, 5, 2], [100, 40]
    stbl = media.box(
        b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(8))), media.full(b"stts", struct.pack(">I4I", 2, 1, 10, 2, 20)),
        media.full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)), media.full(b"stsz", struct.pack(">II3I", 0, 3, *sizes)), media.full(b"co64", struct.pack(">I2Q", 2, *chunks)))
    mdia = media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIII", 0, 0, 90, 50)), media.box(b"minf", stbl))
    inner = media.box(b"trak", mdia)
    blob = media.box(b"free", bytes(7)) + struct.pack(">I4sQ", 1, b"moov", 16 + len(inner)) + inner
    (track,) = media.tracks(blob)
    assert track["codec"] == "avc1" and track["duration"] == 50
    assert track["offsets"].tolist() == [100, 103, 40] and track["times"].tolist() == [0, 10, 30] and track["is_sync"].all()
    with pytest.raises(ValueError):
        media.tracks(struct.pack(">I4s", 100, b"moov"))


def test_containers(spark):
    texts = [None, "", "é" * 40, "x" * 64, "y" * 70000, "same", "same"]
    df = spark.createDataFrame([(None if i == 1 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, codec int")
    rows = media.containers(df).collect()
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.key_begins) == len(r.key_ends) > 0
    assert rows[5][1:] == rows[6][1:]
    assert media.containers(df.where("false")).count() == 0


def test_audit_finds_exactly_the_damaged_records(spark):
    n = 4100  # more than one file, and a last level that is not full
    df = spark.range(n).select(F.when(F.col("id") != 7, F.col("id")).alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.when(F.col("id") % 50 != 3, F.repeat(F.lit("z"), (F.col("id") % 9).cast("int"))).alias("html"))
    listed = warc.manifest(df.select("page_id", warc.record(F.col("url"), F.col("html")).alias("record")), "record", "page_id").cache()
    rows = sorted(listed.collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(n)) and rows[0].page_id is None and rows[4096].file == 1 and rows[4096].begin == 0
    assert all(a.end == b.begin for a, b in zip(rows, rows[1:]) if a.file == b.file)
    copy = listed.select("ordinal", "sha256", (F.col("end") - F.col("begin")).alias("bytes"))
    assert warc.audit(listed, copy).where("damaged").count() == 0
    bad = copy.where("ordinal <> 4099").withColumn("sha256", F.when(F.col("ordinal").isin(0, 15, 16, 4000), F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256")))
    assert sorted(r.ordinal for r in warc.audit(listed, bad).where("damaged").collect()) == [0, 15, 16, 4000, 4099]
    assert warc.audit(listed.where("false"), copy.where("false")).count() == 0 and warc.audit(listed.where("false"), copy).where("damaged").count() == n


def test_record_format(spark):
    row = spark.createDataFrame([("http://a/", "<p>é</p>"), (None, None)], "url string, html string").select(warc.record(F.col("url"), F.col("html")).alias("r")).collect()
    head, body = row[0].r.split("\r\n\r\n", 1)
    assert head.startswith("WARC/1.0\r\n") and "Content-Length: 9" in head and body == "<p>é</p>\r\n\r\n"
    assert "Content-Length: 0" in row[1].r
