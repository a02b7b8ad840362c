"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, found by SimHash sketches.

1. Texts with equal sets of shingles are folded into one node before anything else.
2. A node goes to buckets named by its shingles' least values under fixed permutations, three values to a bucket. Two nodes
   at 0.8 share one of the ten buckets but for 8 in 10,000 such pairs; others hardly ever meet.
3. In a bucket, sketches (256-bit SimHashes of the shingles) are compared bit-sliced: bit planes, carry-save counters, and a
   block is abandoned once all of it is beyond the radius. The radius is more than three standard deviations wider than what
   0.8 calls for, so that it sorts out and does not decide.
4. What the sketches link is a group; in each group the sets of shingles themselves decide.

Buckets are dealt by range, and groups that are large or that cross a partition go through `group_links`: they are cut into
chunks at random, twice, so that a group of near copies is joined in linear work; then only those rows that are not joined
to most of their group are compared with all of it, chunk by chunk. Nothing depends on partitions or on the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import bounded_batches, cut_lineage, only_memo, row_key, shuffle_partitions, slices, stored, utf8
from netquarry.llm.simhash import Planes, components, spread

WORDS = 5
SKETCH_BITS = 256
#: At a similarity of 0.8 the angle is that of a cosine of 8/9: 39 of 256 bits with a standard deviation of 6.
RADIUS = 60
BANDS, BAND_VALUES = 10, 3
#: Rows of a bucket, and shingles of a group, that are compared at once.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 18
#: Buckets up to so many rows are compared together with others.
SMALL_ROWS = 32
#: Words whose hashes a worker remembers.
MEMO_WORDS = 100_000
_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def _odd(n: int, seed: int) -> np.ndarray:
    """n odd constants, hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(f"{seed} {i}") | 1 for i in range(n)], np.uint64)


_place, _permuted, _of_band = _odd(WORDS, 1), _odd(BANDS * BAND_VALUES, 2), _odd(BAND_VALUES, 3)
_steps = np.arange(1, len(_SKETCH) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


# -- shingles ----------------------------------------------------------------


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 42)
        if len(word) < 100:
            self[word] = h
        return h


_hashes = WordHashes()


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the set of the text's shingles, ascending: of all its words if they are fewer; empty without words.

    Words are cut at ASCII white space, A-Z in lower case.
    """
    words = text.lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for k, c in enumerate(_place.tolist()[:len(h)]):
        out += h[k:k + n] * np.uint64(c)
    if 0 < len(h) < WORDS:
        out += np.uint64(len(h))
    return np.unique(spread(out))


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits, each set if it is so in over half the shingles' hashes, as 64-bit words; zero without shingles."""
    ones = np.zeros(SKETCH_BITS, np.int64)
    for at in range(0, len(h), 1 << 13):
        part = spread(h[at:at + (1 << 13), None] + _steps)
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def buckets(h: np.ndarray) -> np.ndarray:
    """The BANDS buckets of a set of shingles: hashes of BAND_VALUES least values each."""
    least = np.full(BANDS * BAND_VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1 << 13):
        least = np.minimum(least, (_permuted[:, None] * h[at:at + (1 << 13)]).min(1))
    return spread((least.reshape(BANDS, BAND_VALUES) * _of_band).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def prints(rows: DataFrame) -> DataFrame:
    """(id, k1, k2, set1, set2, n, the words of the sketch, buckets) for each of rows (id, k1, k2, text); one narrow pass."""
    names = ["id", "k1", "k2", "set1", "set2", "n", *_SKETCH, "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memo("near copies", _hashes.clear)
        for part in slices(batches):
            sets, sizes, sketches, places = [], [], [], []
            for text in utf8(part.column("text")):
                h = shingles(text)
                sets.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                sketches.append(sketch(h))
                places.append(buckets(h))
            two = np.frombuffer(b"".join(sets), np.int64).reshape(-1, 2)
            words = np.array(sketches, np.uint64).view(np.int64)
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names[:3]), *(pa.array(two[:, i].copy()) for i in (0, 1)), pa.array(sizes, pa.int64()), *(pa.array(words[:, i].copy()) for i in range(len(_SKETCH))),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places).view(np.int64)))], names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "k1", "k2", "text").mapInArrow(run, f"id {kind}, k1 long, k2 long, set1 long, set2 long, n long, {', '.join(f'{s} long' for s in _SKETCH)}, buckets array<long>")


# -- comparing ---------------------------------------------------------------


class Forest:
    """Sets of rows that have been joined; `links` holds the pairs that joined two of them."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[b] = a
            self.links.append((i, j))


def set_bits(x: int) -> list[int]:
    data = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(data, bitorder="little")).tolist()


def small_links(sketches: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the rows of many small buckets, which lie one behind the other, as all near pairs would.

    All pairs at the same distance of places are compared at once: planes against themselves, shifted.
    """
    place = np.arange(len(sketches)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place  # rows of the bucket from here on
    planes = Planes(sketches)
    forest = Forest(len(sketches))
    for shift in range(1, int(sizes.max())):
        alive = int.from_bytes(np.packbits(left > shift, bitorder="little").tobytes(), "little")
        for i in set_bits(planes.shifted_within(shift, radius, alive)):
            forest.join(i, i + shift)
    return forest.links


def large_links(sketches: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """The same for a single bucket: each row reached is compared with those that are not reached yet."""
    planes, links = Planes(sketches), []
    whole = [int.from_bytes(x.tobytes(), "little") for x in sketches]
    rest, queue = (1 << len(whole)) - 1, []
    while rest:
        if not queue:
            first = (rest & -rest).bit_length() - 1
            queue, rest = [first], rest & (rest - 1)
            continue
        x = queue.pop()
        near = planes.within(whole[x], radius, rest)
        rest &= ~near
        found = set_bits(near)
        links += [(x, i) for i in found]
        queue += found
    return links


def jaccard_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the sets as all pairs of a Jaccard similarity of 0.8 or more would.

    Such a pair shares one of the rarest elements of both: of n elements, n - ceil(0.8 n) + 1 are looked up.
    """
    n = np.array([len(s) for s in sets])
    if len(sets) < 2 or not n.any():
        return [(0, i) for i in range(1, len(sets))]  # sets without an element are equal
    owner = np.repeat(np.arange(len(sets)), n)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    begin = np.cumsum(n) - n
    rare = np.lexsort((token, count[token], owner))
    looked_up = (np.arange(len(rare)) - begin[owner] < (n - (4 * n + 4) // 5 + 1)[owner]) & (count[token[rare]] > 1)
    keys, owners = token[rare][looked_up], owner[looked_up]
    by_key = np.argsort(keys, kind="stable")
    posted, holders = keys[by_key], owners[by_key]
    own_begin, own_end = np.searchsorted(owners, np.arange(len(sets))), np.searchsorted(owners, np.arange(len(sets)), "right")
    label, links, mark = np.arange(len(sets)), [], np.zeros(len(count), bool)
    for x in range(len(sets)):
        mine = keys[own_begin[x]:own_end[x]]
        if not len(mine):
            continue
        flag = np.zeros(len(sets), bool)
        for a, b in zip(np.searchsorted(posted, mine).tolist(), np.searchsorted(posted, mine, "right").tolist()):
            flag[holders[a:b]] = True
        other = np.flatnonzero(flag[x + 1:] & (label[x + 1:] != label[x])) + x + 1
        other = other[(5 * n[other] >= 4 * n[x]) & (5 * n[x] >= 4 * n[other])]
        if not len(other):
            continue
        mark[token[begin[x]:begin[x] + n[x]]] = True
        # as many at once as have a block's elements
        for part in np.split(other, np.flatnonzero(np.diff(np.cumsum(n[other]) // BLOCK_SHINGLES)) + 1):
            size = n[part]
            at = np.repeat(begin[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            both = np.add.reduceat(mark[token[at]].astype(np.int64), np.cumsum(size) - size)
            for y in part[9 * both >= 4 * (n[x] + size)].tolist():  # both / (a + b - both) >= 4 / 5
                if label[y] != label[x]:
                    links.append((x, y))
                    label[label == label[y]] = label[x]
        mark[token[begin[x]:begin[x] + n[x]]] = False
    return links


# -- buckets and groups -------------------------------------------------------


def bucket_stream(batches: Iterable[pa.RecordBatch], block_rows: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """(links, rows (bucket, node, sketch) to be compared elsewhere) of a partition's rows, sorted by bucket.

    The first and the last bucket may go on in other partitions; they, and those of more rows than a block, are left as they are.
    """
    width = 2 + len(_SKETCH)
    first = large = None
    held = np.zeros((0, width), np.int64)  # of the bucket that has not ended yet
    small: list[np.ndarray] = []

    def join_small() -> list[tuple[int, int]]:
        rows, out = np.concatenate(small), []
        small.clear()
        starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        sizes = np.diff(np.append(starts, len(rows)))
        for low in (2, 4, 8, 16, 32):  # buckets of about the same size together
            some = (sizes >= low) & (sizes < 2 * low)
            if some.any():
                mine, size = rows[np.repeat(some, sizes)], sizes[some]
                node = mine[:, 1].tolist()
                out += [(node[a], node[b]) for a, b in small_links(words_of(mine), np.cumsum(size) - size, size)]
        return out

    def words_of(rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows[:, 2:]).view(np.uint64)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy() for c in ("bucket", "node", *_SKETCH)], axis=1)
        if first is None:
            first = rows[0, 0]
        rows = np.concatenate([held, rows])
        cuts = np.append(np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])), len(rows))
        size = np.diff(cuts)
        links, again = [], []
        look = size > 1  # most buckets have a single row
        look[[0, -1]] = True
        for a, b in zip(cuts[:-1][look].tolist(), cuts[1:][look].tolist()):
            part = rows[a:b]
            key = part[0, 0]
            if key in (first, large) or len(part) > block_rows:
                again.append(part)
                if b == len(rows):
                    large = key
            elif b == len(rows):
                held = part.copy()
                break
            elif 1 < len(part) <= SMALL_ROWS:
                small.append(part)
            elif len(part) > 1:
                node = part[:, 1].tolist()
                links += [(node[i], node[j]) for i, j in large_links(words_of(part))]
        else:
            held = rows[:0]
        if sum(map(len, small)) > 1 << 15:
            links += join_small()
        else:
            small = [x.copy() for x in small]  # else they keep the whole batch
        yield links, np.concatenate(again) if again else rows[:0]
    yield join_small() if small else [], held


def in_buckets(distinct: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(links (u, v), rows (group, node, cost, the words of the sketch) of buckets that are left to group_links)."""
    names = ["link", "u", "v", *_SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for links, again in bucket_stream(batches, block_rows):
            if links:
                two = np.array(links, np.int64)
                nothing = pa.nulls(len(links), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(links), bool)), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), *[nothing] * len(_SKETCH)], names)
            if len(again):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(again), bool)), *(pa.array(again[:, i].copy()) for i in range(again.shape[1]))], names)

    n = shuffle_partitions(distinct.sparkSession)
    rows = distinct.select(F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("bucket"), "node", *_SKETCH)
    dealt = rows.repartitionByRange(n, "bucket", "node").sortWithinPartitions("bucket")
    found = cut_lineage(dealt.mapInArrow(run, f"link boolean, u long, v long, {', '.join(f'{s} long' for s in _SKETCH)}"))
    again = found.where("NOT link").select(F.col("u").alias("group"), F.col("v").alias("node"), F.lit(1).cast("long").alias("cost"), *_SKETCH)
    return found.where("link").select("u", "v"), again


Compare = Callable[[pa.Table], list[tuple[int, int]]]


def compared(keyed: DataFrame, compare: Compare) -> DataFrame:
    """(u, v): the links that compare finds among the rows of each key, of (key, node, ...); written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            node = rows.column("node").to_numpy()
            if len(node) > 1 and (links := compare(rows)):
                two = node[np.array(links, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], ["u", "v"])

        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if keys[a] != key and held:
                    yield from close()
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    n = shuffle_partitions(keyed.sparkSession)
    return cut_lineage(keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long"))


def group_links(rows: DataFrame, attach: Callable[[DataFrame], DataFrame], compare: Compare, limit: int, known: DataFrame | None = None) -> DataFrame:
    """(u, v): links that join the rows (group, node, cost, ...) of each group as all its linked pairs would.

    A group whose costs sum up to more than the limit is cut into chunks, by two hashes of the node: chunks of the one have
    rows in common with those of the other, so that what belongs together is joined through them. Rows that are then outside
    the largest part of their group are compared with every chunk of it, and with each other. attach adds what compare needs
    to rows with a key. known: links found before.
    """
    n = rows.count()
    # only groups beyond the limit: as many as it goes into all costs, so that no join gathers the rows of a group
    sizes = stored(rows.groupBy("group").agg(F.ceil(F.sum("cost") / limit).alias("chunks")).where("chunks > 1"), n)
    cut = rows.join(sizes, "group", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    deals = F.when(F.col("chunks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = cut.withColumn("deal", F.explode(deals)).withColumn("key", F.xxhash64("group", "deal", F.pmod(F.xxhash64("node", "deal"), F.greatest("chunks", F.lit(1)))))
    links = compared(attach(dealt.drop("group", "chunks", "deal", "cost")), compare)
    if sizes.isEmpty():
        return links
    so_far = links if known is None else links.unionByName(known)
    roots = components(so_far)
    large = cut.where("chunks > 1").drop("chunks").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = large.groupBy("group", "root").agg(F.sum("cost").alias("cost"))
    most = parts.groupBy("group").agg(F.max_by("root", F.struct("cost", "root")).alias("main"), F.max("cost").alias("of_main"), F.sum("cost").alias("all"))
    most = stored(most.where(F.col("all") > F.col("of_main")).select("group", "main", F.ceil(F.col("of_main") / limit).alias("mains"), F.ceil((F.col("all") - F.col("of_main")) / limit).alias("others")), n)
    if most.isEmpty():
        return links
    rest = large.join(most, "group")
    other = F.col("root") != F.col("main")
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.when(other, F.col("others")).otherwise(F.col("mains")))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    key = lambda kind, a, b: F.xxhash64("group", F.lit(kind), a, b)
    with_main = F.transform(each("mains"), lambda i: key("main", F.col("own"), i))
    with_others = F.transform(each("others"), lambda j: key("others", F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    of_main = F.transform(each("others"), lambda j: key("main", j, F.col("own")))
    keyed = rest.withColumn("own", own).withColumn("key", F.explode(F.when(other, F.concat(with_main, with_others)).otherwise(of_main)))
    return links.unionByName(compared(attach(keyed.drop("group", "cost", "root", "main", "mains", "others", "own")), compare))


def by_sketches(rows: pa.Table) -> list[tuple[int, int]]:
    return large_links(np.stack([rows.column(s).to_numpy() for s in _SKETCH], axis=1).view(np.uint64))


def by_shingles(rows: pa.Table) -> list[tuple[int, int]]:
    only_memo("near copies", _hashes.clear)
    return jaccard_links([shingles(x or b"") for x in rows.column("text").cast(pa.binary()).to_pylist()])


# -- the operator ---------------------------------------------------------------


def classes(df: DataFrame, id_col: str, text_col: str, block_rows: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(rows (id, set1, set2) of df, (set1, set2, component_id)), both written."""
    bounded_batches(df)
    texts = row_key(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    fps = cut_lineage(prints(texts).select("id", "k1", "k2", "set1", "set2", "n", *_SKETCH, *[F.get("buckets", F.lit(i)).alias(f"b{i}") for i in range(BANDS)]))
    same = ["k1", "k2", "n", *_SKETCH, *[f"b{i}" for i in range(BANDS)]]  # all but the first two follow from the set
    folded = fps.groupBy("set1", "set2").agg(F.min("id").alias("low"), *[F.first(c).alias(c) for c in same])
    distinct = cut_lineage(folded.withColumn("node", F.monotonically_increasing_id()))  # the numbers are fixed once they are written
    n = distinct.count()
    near, again = in_buckets(distinct, block_rows)
    near = near.unionByName(group_links(again, lambda x: x, by_sketches, block_rows, near))
    groups = components(near).withColumnRenamed("root", "group")
    members = cut_lineage(groups.join(distinct.select("node", "k1", "k2", (F.col("n") + 1).alias("cost")), "node"), n)
    found = components(group_links(members, lambda x: x.join(texts.select("k1", "k2", "text"), ["k1", "k2"]).select("key", "node", "text"), by_shingles, block_shingles))
    linked = cut_lineage(found.join(distinct.select("node", "low"), "node"), n)
    lows = linked.groupBy("root").agg(F.min("low").alias("component"))
    named = linked.select("node", "root").join(lows, "root").select("node", "component")
    every = cut_lineage(distinct.join(named, "node", "left").select("set1", "set2", F.coalesce("component", "low").alias("component_id")), n)
    return fps.select("id", "set1", "set2"), every


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, component_id) for every row: the smallest id that is reachable over pairs of a similarity of 0.8 or more.

    Texts without words are alike; a null text counts as empty; one of fewer words than a shingle is a single shingle. Null
    ids take part but name no component, unless all ids of one are null. Repeated rows come out as they came in; an empty
    table gives an empty one; other columns of df are not read. Copies are folded before any comparison, and no list of a
    component's members is ever made.
    """
    rows, every = classes(df, id_col, text_col, block_rows, block_shingles)
    return rows.join(every, ["set1", "set2"]).select(F.col("id").alias(id_col), "component_id")


def smallest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id): the component ids of near_copies(), each once; rows of other ids have a near copy with a smaller one."""
    return classes(df, id_col, text_col, BLOCK_ROWS, BLOCK_SHINGLES)[1].select(F.col("component_id").alias(id_col)).distinct()
