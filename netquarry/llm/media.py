"""ISO media containers: a writer of one-track files with raw 8-bit samples, and a reader that walks the nested boxes.

The reader decodes the sample tables only; it never looks into the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import bounded_batches, from_buffer, slices, utf8

#: A sample (access unit) of the written track has this many bytes, one tick each.
UNIT = 64
#: Units in a chunk of the written track; the first unit of each chunk is a sync sample.
UNITS_IN_CHUNK = 16
TIMESCALE = 8000
#: Boxes that hold boxes (fixed values of ISO/IEC 14496-12).
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(kind: bytes, rows: np.ndarray, *before: bytes) -> bytes:
    return full(kind, *before, struct.pack(">I", len(rows)), rows.tobytes())


def pack(data: bytes) -> bytes:
    """A file whose one track holds data, with zeros up to a positive multiple of 64 bytes, as unsigned 8-bit samples.

    The bytes depend on data alone.
    """
    payload = data + bytes(-len(data) % UNIT if data else UNIT)
    units = len(payload) // UNIT
    chunks = -(-units // UNITS_IN_CHUNK)
    last = units - (chunks - 1) * UNITS_IN_CHUNK
    ticks = len(payload)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    to_chunk = [(1, UNITS_IN_CHUNK, 1)] * (chunks > 1 or last == UNITS_IN_CHUNK) + [(chunks, last, 1)] * (last < UNITS_IN_CHUNK)
    u32 = ">u4"
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (UNIT * UNITS_IN_CHUNK)
        wide = bool(offsets[-1] >= 1 << 32)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            table(b"stts", np.array([[units, UNIT]], u32)),
            table(b"stss", np.arange(1, units + 1, UNITS_IN_CHUNK).astype(u32)),
            table(b"stsc", np.array(to_chunk, u32)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            table(b"co64", offsets.astype(">u8")) if wide else table(b"stco", offsets.astype(u32)),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl),
        )
        track = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7)
        return box(b"moov", full(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1), box(b"trak", track, media))

    long_size = 8 * (len(payload) + 8 >= 1 << 32)
    first = len(head) + len(moov(0)) + 8 + long_size  # the offsets' width can't change: what it rests on is payload's size
    return head + moov(first) + box(b"mdat", payload)


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the bodies of the boxes in a stretch; size 0 is up to the end, size 1 has 64 bits more."""
    while at + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if n == 1:
            n = struct.unpack_from(">Q", data, at + 8)[0]
            body += 8
        n = n or end - at
        if n < body - at or at + n > end:
            raise ValueError(f"box {kind!r} at {at} doesn't fit")
        yield kind, body, at + n
        at += n


def walk(data: memoryview, at: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    for kind, a, b in boxes(data, at, end):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            yield from walk(data, a, b, (*path, kind))


def column(data: memoryview, at: int, width: int, kind: str = ">u4") -> np.ndarray:
    """The rows of a counted table that starts at this place."""
    n = struct.unpack_from(">I", data, at)[0]
    return np.frombuffer(data, kind, n * width, at + 4).reshape(n, width).astype(np.int64)


def tracks(blob: bytes) -> list[dict]:
    """For each track: codec, timescale, duration, and every sample's time, offset, size and whether it is a sync sample."""
    data, out = memoryview(blob), []
    t: dict = {}
    for path, a, b in walk(data, 0, len(data)):
        kind = path[-1]
        if kind == b"trak":
            out.append(t := {"sync": None})
        elif b"trak" not in path:
            continue
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
        elif kind == b"hdlr":
            t["handler"] = bytes(data[a + 8:a + 12]).decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = bytes(data[a + 12:a + 16]).decode("latin-1").strip()
        elif kind == b"stts":
            t["stts"] = column(data, a + 4, 2)
        elif kind == b"stss":
            t["sync"] = column(data, a + 4, 1)[:, 0]
        elif kind == b"stsc":
            t["stsc"] = column(data, a + 4, 3)
        elif kind == b"stsz":
            one, n = struct.unpack_from(">II", data, a + 4)
            t["sizes"] = np.full(n, one, np.int64) if one else column(data, a + 8, 1)[:, 0]
        elif kind in (b"stco", b"co64"):
            t["chunks"] = column(data, a + 4, 1, ">u8" if kind == b"co64" else ">u4")[:, 0]
    return [resolve(t) for t in out]


def resolve(t: dict) -> dict:
    """Joins the sample tables: the chunk of each sample, its place in there, its time."""
    sizes, chunks, runs = t["sizes"], t["chunks"], t["stsc"]
    each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks))))  # samples in each chunk
    first = np.cumsum(each) - each
    if each.sum() != len(sizes):
        raise ValueError("the chunk table doesn't cover the samples")
    before = np.cumsum(sizes) - sizes
    starts = before[np.minimum(first, max(len(sizes) - 1, 0))] if len(sizes) else before
    offsets = before + np.repeat(chunks - starts, each) if len(sizes) else before
    steps = np.repeat(t["stts"][:, 1], t["stts"][:, 0])
    sync = np.ones(len(sizes), bool)
    if t["sync"] is not None:
        sync[:] = False
        sync[t["sync"] - 1] = True
    return t | {"offsets": offsets, "times": np.cumsum(steps) - steps, "is_sync": sync}


def read_samples(blob: bytes, track: dict) -> bytes:
    """The stored samples in order; neighbouring ones are read together."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, ends = np.append(0, breaks), np.append(breaks, len(offsets)) - 1
    return b"".join([blob[offsets[a]:offsets[b] + sizes[b]] for a, b in zip(starts, ends)])


def containers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """(id, n_bytes, media, codec, timescale, duration, n_samples, key_begins, key_ends, payload digests) for every row.

    media is the stored file (left out without keep_media); key_begins and key_ends are the keyframes' byte ranges in it,
    as the sample tables have them. payload_* describe the samples read back. A null text counts as empty and stores 64
    zero bytes. Equal texts give equal values; repeated rows and null ids come out as they came in; an empty table gives an
    empty one; other columns of df are not read. One narrow pass.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows: dict[str, list] = {k: [] for k in names[1:]}
            for data in utf8(part.column("text")):
                blob = pack(data)
                track = tracks(blob)[0]
                payload = read_samples(blob, track)
                begins = track["offsets"][track["is_sync"]]
                for k, v in (
                    ("n_bytes", len(data)), ("codec", track["codec"]), ("timescale", track["timescale"]), ("duration", track["duration"]), ("n_samples", len(track["sizes"])),
                    ("key_begins", begins.tobytes()), ("key_ends", (begins + track["sizes"][track["is_sync"]]).tobytes()), ("payload_bytes", len(payload)),
                    ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-64:])), ("media_bytes", len(blob)),
                    ("media_sha256", hashlib.sha256(blob).hexdigest()), ("media", blob),
                ):
                    if k in rows:
                        rows[k].append(v)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(from_buffer(v, np.int64) if k.startswith("key_") else pa.array(v, kinds[k]) for k, v in rows.items())], names)

    bounded_batches(df)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = (
        f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, codec string, timescale long, duration long, n_samples long, key_begins array<long>, "
        "key_ends array<long>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string" + ", media binary" * keep_media)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {x.split()[0]: {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}.get(x.split()[1]) for x in schema.split(", ")}
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
