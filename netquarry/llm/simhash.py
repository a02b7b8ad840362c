"""SimHash near-dedup with bit-sliced comparison.

Fingerprints of 64 bits link at a radius of differing bits. Of `BLOCKS` blocks of bits `BLOCKS` - `RADIUS` at least are then
equal, so each fingerprint goes to the buckets of every choice of that many blocks. Buckets are dealt by range and sorted,
so that a large bucket spreads over partitions; within a bucket, fingerprints are kept as vertical bit planes, and one
fingerprint is compared with a whole block by carry-save counters. A bucket that is too large for one block, or that crosses
partitions, goes to another round under narrower masks: its free bits are split in RADIUS + 1 parts, one of which must be
equal. A mask that leaves f bits free has at most 2 to the f distinct fingerprints, so this ends after a few rounds, with
nothing left out.

Texts that are alike by 5-word shingles at a similarity of 0.8 differ in about ten bits of 64: see near_copies for those.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import bounded_batches, cut_lineage, shuffle_partitions, slices, stored, utf8

BITS = 64
#: Bits in which linked fingerprints differ at most, and blocks of bits: 20 buckets of 31 to 33 bits.
RADIUS, BLOCKS = 3, 6
#: Fingerprints of a bucket that are compared as one block of bit planes.
BLOCK_ROWS = 4096
_all = (1 << BITS) - 1
_table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The masks of blocks - radius of the blocks of bits."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def narrower(mask: int, radius: int) -> list[int]:
    """The mask with each part of its free bits added: of two fingerprints at the radius, one of radius + 1 parts is equal."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [round(i * len(free) / (radius + 1)) for i in range(radius + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


# -- fingerprints ------------------------------------------------------------


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits that are set in over half the hashes, packed; a row of hashes has one or more 64-bit words."""
    data = hashes.reshape(len(hashes), -1).view(np.uint8)
    if len(data) < 2000:
        ones = np.unpackbits(data, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(data[:, i], minlength=256) @ _table for i in range(data.shape[1])])
    return np.packbits(ones * 2 > len(data), bitorder="little")


def shingle_hashes(words: list[bytes], words_in_shingle: int) -> np.ndarray:
    """XXH64 of each shingle of the words, repeats included; of all the words if they are fewer."""
    data, w, h = b" ".join(words), words_in_shingle, xxhash.xxh64_intdigest
    if len(words) <= w:
        return np.array([h(data, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - w + 1].tolist()
    return np.array([h(data[a:b], 42) for a, b in zip(starts, ends[w - 1:].tolist())], np.uint64)


def fingerprint(text: bytes, words_in_shingle: int) -> int:
    """Bits set in over half the shingles' XXH64; shingles of words of the text with A-Z in lower case, repeats included."""
    words = text.lower().split()
    return int(majority(shingle_hashes(words, words_in_shingle)).view(np.uint64)[0]) if words else 0


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """(id, fp) for every row, fp as a signed long; one narrow pass. A null text counts as empty and has fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(x, words_in_shingle) for x in utf8(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    bounded_batches(df)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


# -- links -------------------------------------------------------------------


class Planes:
    """Fingerprints of one bucket as vertical bit planes: bit i of plane b is bit b of fingerprint i."""

    def __init__(self, fps: np.ndarray, bits: Iterable[int] | None = None):
        """fps: a row of 64-bit words for each fingerprint; bits: those that can differ, or all."""
        rows = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
        bits = range(rows.shape[1]) if bits is None else bits
        self.planes = [(b, int.from_bytes(np.packbits(rows[:, b], bitorder="little").tobytes(), "little")) for b in bits]
        self.every = (1 << len(rows)) - 1

    def counted(self, differing: Iterable[int], radius: int, among: int) -> int:
        """The places in `among` that are set in no more than radius of the planes.

        They are counted in planes of a carry-save adder that starts so high that radius + 1 overflow it.
        """
        digits = radius.bit_length()
        start = (1 << digits) - 1 - radius
        counts = [among if start >> i & 1 else 0 for i in range(digits)]
        over = 0
        for carry in differing:
            carry &= among
            for i in range(digits):
                counts[i], carry = counts[i] ^ carry, counts[i] & carry
                if not carry:
                    break
            else:
                over |= carry
                if over == among:
                    return 0
        return among & ~over

    def within(self, fp: int, radius: int, among: int | None = None) -> int:
        """A bit for each fingerprint, of those in `among`, at the radius or nearer to fp."""
        every = self.every
        return self.counted((plane ^ every if fp >> b & 1 else plane for b, plane in self.planes), radius, every if among is None else among)

    def shifted_within(self, shift: int, radius: int, among: int) -> int:
        """A bit for each fingerprint, of those in `among`, at the radius or nearer to the one so many places on."""
        return self.counted((plane ^ (plane >> shift) for _, plane in self.planes), radius, among)


def bucket_links(fps: list[int], mask: int, radius: int) -> list[tuple[int, int]]:
    """Links that join a bucket's fingerprints as all linked pairs would; fewer than fingerprints."""
    if len(fps) == 2:
        return [(fps[0], fps[1])] if (fps[0] ^ fps[1]).bit_count() <= radius else []
    planes = Planes(np.array(fps, np.uint64)[:, None], [b for b in range(BITS) if not mask >> b & 1])
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []
    for i, fp in enumerate(fps):
        near = planes.within(fp, radius) >> (i + 1)
        j = i + 1
        while near:
            skip = (near & -near).bit_length() - 1
            j += skip
            near >>= skip + 1
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links.append((fp, fps[j]))
            j += 1
    return links


def stream(batches: Iterable[pa.RecordBatch], whole: bool, radius: int, block_rows: int) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """(links, rows (mask, fp) for another round) of a partition's sorted buckets.

    whole: no bucket goes on in another partition, and none is too large.
    """
    mask, value, rows, first, spill = None, None, [], True, False

    def close(last: bool) -> tuple[list, list]:
        if spill or not whole and (first or last):
            return [], [(mask, x) for x in rows]
        return bucket_links(rows, mask, radius) if len(rows) > 1 else [], []

    links, again = [], []
    for batch in batches:
        ms, xs, vs = (batch.column(c).to_numpy().view(np.uint64) for c in ("mask", "fp", "value"))
        if not len(ms):
            continue
        cuts = np.flatnonzero((ms[1:] != ms[:-1]) | (vs[1:] != vs[:-1])) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(ms))
        # most buckets have a single fingerprint; only the others, the first and the last are looked at
        several = ends - starts > 1
        several[[0, -1]] = True
        for a, b in zip(starts[several].tolist(), ends[several].tolist()):
            if (mask, value) != (int(ms[a]), int(vs[a])):
                got = close(last=False)
                links += got[0]
                again += got[1]
                first = mask is None
                mask, value, rows, spill = int(ms[a]), int(vs[a]), [], False
            for i in range(a, b, block_rows):
                rows += xs[i:min(b, i + block_rows)].tolist()
                if len(rows) > block_rows and not whole:
                    spill = True
                    again += [(mask, x) for x in rows]
                    rows = []
                    yield links, again
                    links, again = [], []
        yield links, again
        links, again = [], []
    got = close(last=True)
    yield links + got[0], again + got[1]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): links between distinct fingerprints (fp), enough that components are those of all linked pairs.

    In the last round a bucket holds at most 4 * block_rows fingerprints, in those before it block_rows.
    """
    spark = distinct.sparkSession
    n = shuffle_partitions(spark)
    first = masks(radius, blocks)
    rows = distinct.select(F.explode(F.array(*[F.lit(signed(m)) for m in first])).alias("mask"), "fp")
    out: DataFrame | None = None
    free = max(BITS - m.bit_count() for m in first)
    while True:
        whole = 1 << free <= 4 * block_rows  # the bits that are free bound every bucket

        def run(batches: Iterator[pa.RecordBatch], whole: bool = whole) -> Iterator[pa.RecordBatch]:
            for found, again in stream(batches, whole, radius, block_rows):
                if found or again:
                    u = [signed(a) for a, _ in found] + [signed(m) for m, _ in again]
                    v = [signed(b) for _, b in found] + [signed(x) for _, x in again]
                    yield pa.RecordBatch.from_arrays([pa.array([True] * len(found) + [False] * len(again)), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["link", "u", "v"])

        keyed = rows.withColumn("value", F.col("mask").bitwiseAND(F.col("fp")))
        dealt = keyed.repartition(n, "mask", "value") if whole else keyed.repartitionByRange(n, "mask", "value", "fp")
        found = cut_lineage(dealt.sortWithinPartitions("mask", "value", "fp").select("mask", "value", "fp").mapInArrow(run, "link boolean, u long, v long"))
        here = found.where("link").select("u", "v")
        out = here if out is None else out.unionByName(here)
        again = found.where("NOT link").select(F.col("u").alias("mask"), F.col("v").alias("fp"))
        if whole or again.isEmpty():
            return out
        used = [r.mask for r in again.select("mask").distinct().collect()]  # a round's masks are choices of bits, not data: dozens at first, thousands at most
        table = {m: narrower(m & _all, radius) for m in used}
        free = max(BITS - x.bit_count() for xs in table.values() for x in xs)
        options = spark.createDataFrame([(m, [signed(x) for x in xs]) for m, xs in table.items()], "mask long, narrower array<long>")
        rows = again.join(F.broadcast(options), "mask").select(F.explode("narrower").alias("mask"), "fp").distinct()


# -- components --------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the component's smallest node.

    Alternates large and small stars: every node hands its larger, then its smaller neighbours to the smallest one it
    knows. Minima are taken by aggregates that combine before the shuffle, and joins are left to split skewed keys, so a
    node with very many neighbours is never gathered. The edges of each round are written to the shared folder.
    """
    def undirected(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    n = edges.count()  # no round has more
    edges = stored(undirected(edges), n)
    seen = signature(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = undirected(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = stored(undirected(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))), 2 * seen[0])
        now = signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id that is reachable over fingerprints that link.

    Texts with the same fingerprint are linked, those without words too (fingerprint 0); a null text counts as empty. Null
    ids take part but name no component, unless all ids of one are null. Repeated rows come out as they came in; an empty
    table gives an empty one; other columns of df are not read. Copies are folded into one fingerprint before any
    comparison, and no list of a component's members is ever made.
    """
    fps = cut_lineage(fingerprints(df, id_col, text_col, words_in_shingle))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("id").alias("low")))
    n = distinct.count()
    linked = cut_lineage(components(links(distinct, radius, blocks)).withColumnRenamed("node", "fp").join(distinct, "fp"), n)
    lows = linked.groupBy("root").agg(F.min("low").alias("component"))
    named = linked.select("fp", "root").join(lows, "root").select("fp", "component")
    # written, so that both sides of the last join are dealt anew and a fingerprint with very many copies can be split
    every = cut_lineage(distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id")), n)
    return fps.join(every, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
