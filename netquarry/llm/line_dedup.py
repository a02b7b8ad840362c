"""Line dedup by sorted hashes and keep bitmaps.

Every line of every document becomes a 128-bit hash of its key with the document and the position, no text. The hashes
are dealt by range and sorted by hash, document and position, so that each partition streams over the runs of equal
lines. A run that crosses partitions (one very common line fills many) leaves a partial count at each of its ends, and
those few counts are added up. What comes back is one compressed bitmap for each document that loses lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import bounded_batches, cut_lineage, row_key, shuffle_partitions, slices, utf8

SPACE = b"\t\n\v\f\r "
#: Kinds of rows that the streaming pass leaves: a line that goes, a line whose run goes on elsewhere, a run's count here.
GOES, OPEN, COUNT = 0, 1, 2
#: A key of more words is long, where long lines have a threshold of their own.
LONG_WORDS = 50


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends (ASCII only) and with A-Z in lower case."""
    return line.strip(SPACE).lower()


def line_hashes(rows: DataFrame, mark_long: bool = False) -> DataFrame:
    """(h1, h2, id, k1, k2, pos, n_lines) for every line with a key of a code point or more; rows has id, k1, k2 and text.

    With mark_long the lowest bit of h2 says whether the key is long.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, row, place, total, long = [], [], [], [], []
            for i, text in enumerate(utf8(part.column("text"))):
                lines = text.split(b"\n")
                for pos, line in enumerate(lines):
                    if key := line_key(line):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        row.append(i)
                        place.append(pos)
                        total.append(len(lines))
                        if mark_long:
                            long.append(len(key.split(None, LONG_WORDS)) > LONG_WORDS)
            two = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            if mark_long:
                two = np.stack([two[:, 0], two[:, 1] & ~1 | np.array(long, np.int64)], axis=1)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), *(part.column(c).take(at) for c in ("id", "k1", "k2")), pa.array(place, pa.int32()), pa.array(total, pa.int32())], names)

    kind = rows.schema["id"].dataType.simpleString()
    names = ["h1", "h2", "id", "k1", "k2", "pos", "n_lines"]
    return rows.select("id", "k1", "k2", "text").mapInArrow(run, f"h1 long, h2 long, id {kind}, k1 long, k2 long, pos int, n_lines int")


def frequent_lines(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool, long_docs: int | None = None) -> Iterator[list[tuple]]:
    """Streams over a partition's sorted lines and yields rows (kind, h1, h2, id, k1, k2, pos, n_lines, documents).

    A run's lines go as soon as it has min_docs documents (long_docs, if given, for those marked as long); up to then they wait, so that no more wait than the lines of
    min_docs documents. The first and last run of a partition may go on elsewhere: their counts are given, and lines that
    still wait at the end of such a run are left open. With keep_first a run's first line stays; where the run may go on
    elsewhere, its count comes with that line, for only the very first one stays.
    """
    out: list[tuple] = []
    run, doc, n, waiting, first_run, head, least = None, None, 0, [], True, None, min_docs

    def close(last: bool) -> None:
        if run is not None and (first_run or last):
            out.append((COUNT, *run, *head, n))
            out.extend((OPEN, *run, *w, n) for w in waiting)

    for batch in batches:
        for h1, h2, *line in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "id", "k1", "k2", "pos", "n_lines"))):
            opens = (h1, h2) != run
            if opens:
                close(last=False)
                first_run = run is None
                run, doc, n, waiting, head = (h1, h2), None, 0, [], line
                least = long_docs if long_docs is not None and h2 & 1 else min_docs
            if line[1:3] != doc:
                doc, n = line[1:3], n + 1
                if n == least:
                    out.extend((GOES, *run, *w, n) for w in waiting)
                    waiting = []
            if keep_first and line == head:
                pass  # repeated rows have it more than once
            elif n >= least:
                out.append((GOES, *run, *line, n))
            else:
                waiting.append(line)
            if len(out) >= 20_000:
                yield out
                out = []
    close(last=True)
    yield out


def bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False, long_docs: int | None = None) -> DataFrame:
    """(k1, k2, n_lines, keep): one row for each document that loses a line; keep is a zlib-compressed bitmap, 1 for stays.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case; keys of min_docs documents
    or more lose all their lines, or with keep_first all but the first (by id, null first, then row key and position).
    long_docs is the threshold of keys of more than LONG_WORDS words, if they have one of their own. Lines with an empty key
    always stay. Repeated rows (equal id and text) are one document, here and in apply(); k1 and k2
    identify it. A null text is one empty line. An empty table gives an empty one. No hash's lines are ever gathered: a
    very common line's run is dealt over as many partitions as it needs.
    """
    bounded_batches(df)
    spark = df.sparkSession
    rows = row_key(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    order = ["h1", "h2", "id", "k1", "k2"]
    dealt = line_hashes(rows, long_docs is not None).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "pos")
    kind = rows.schema["id"].dataType.simpleString()
    names = ["kind", "h1", "h2", "id", "k1", "k2", "pos", "n_lines", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), None, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[3] = batch.column("id").type
                yield batch

        for out in frequent_lines(seen(), min_docs, keep_first, long_docs):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    # several passes read what the stream leaves, and the ranges of a second shuffle could differ
    left = cut_lineage(dealt.mapInArrow(run, f"kind int, h1 long, h2 long, id {kind}, k1 long, k2 long, pos int, n_lines int, docs long"))
    # at most two rows for each partition of the shuffle
    counts = left.where(F.col("kind") == COUNT)
    line = F.struct("id", "k1", "k2", "pos")
    least = F.lit(min_docs) if long_docs is None else F.when(F.col("h2").bitwiseAND(1) == 1, long_docs).otherwise(min_docs)
    totals = counts.groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.min(line).alias("head")).where(F.col("total") >= least)
    goes = [left.where(F.col("kind") == GOES), left.where(F.col("kind") == OPEN).join(F.broadcast(totals), ["h1", "h2"], "left_semi")]
    if keep_first:
        goes.append(counts.join(F.broadcast(totals), ["h1", "h2"]).where(~line.eqNullSafe(F.col("head"))))
    every = goes[0].select("k1", "k2", "n_lines", "pos")
    for more in goes[1:]:
        every = every.unionByName(more.select("k1", "k2", "n_lines", "pos"))
    gone = every.groupBy("k1", "k2").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, positions in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist()):
                bits = np.ones(n, bool)
                bits[positions] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("n_lines"), pa.array(keep, pa.binary())], ["k1", "k2", "n_lines", "keep"])

    return gone.mapInArrow(pack, "k1 long, k2 long, n_lines int, keep binary")


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def apply(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept) and df's other columns for every row of df; kept is the text of the lines that stay.

    A document without a bitmap keeps everything; one that loses all lines keeps the empty text. Columns of df that are
    called like those added here are replaced.
    """
    added = ["n_lines", "n_dropped", "kept", "k1", "k2"]
    extra = [c for c in df.columns if c not in (id_col, text_col, *added)]
    rows = row_key(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.struct(*extra).alias("extra") if extra else F.lit(0).alias("extra")), "_id", "text")
    joined = rows.join(found.select("k1", "k2", "keep"), ["k1", "k2"], "left").select("_id", "text", "keep", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, dropped, kept = [], [], []
            for text, keep in zip(utf8(part.column("text")), part.column("keep").to_pylist()):
                lines = text.split(b"\n")
                stay = lines if keep is None else [x for x, k in zip(lines, unpack(keep, len(lines)).tolist()) if k]
                n.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), part.column("extra")], names)

    names = ["_id", "n_lines", "n_dropped", "kept", "extra"]
    kind = lambda c: joined.schema[c].dataType.simpleString()
    done = joined.mapInArrow(run, f"_id {kind('_id')}, n_lines long, n_dropped long, kept string, extra {kind('extra')}")
    return done.select(F.col("_id").alias(id_col), "n_lines", "n_dropped", "kept", *[F.col(f"extra.`{c}`").alias(c) for c in extra])
