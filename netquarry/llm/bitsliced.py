"""Ranked lexical search over a bit-sliced impact index.

Documents come in blocks, each a row of the index: ids, lengths, and for each term that the block holds which of its documents
do, how often. A term's impacts on a block's documents are whole numbers of few bits; slice b of a term is a bitmap of the
documents whose impact has bit b. An item's scores are the sum of its terms' slices, added for all documents of a block at
once by carry-save steps over three numbers and one last carry, and the best are found from the most significant slice down:
as long as more documents than wanted have the bit, the others leave; else those that have it are in. Impacts hang on figures
of the whole corpus, so slices are made of the stored counts when a block is searched, once for each term.
"""

from __future__ import annotations

import math
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import slices, stored, utf8

#: Documents and postings of a block at most (a single document may have more postings).
DOCS_IN_BLOCK, POSTINGS_IN_BLOCK = 1 << 13, 1 << 21
#: Bytes of a text that are cut into terms at once, of slices that a task remembers, of items that one pass over the index serves.
SEGMENT, CACHE_BYTES, PASS_BYTES = 1 << 20, 32 << 20, 1 << 20
#: What a byte of a text becomes: letters, digits and all beyond ASCII belong to terms (A-Z as a-z), the others divide them.
FOLDED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, as lists for about SEGMENT bytes each."""
    at = 0
    while at < len(data):
        end = at + SEGMENT
        if end < len(data):  # on to the end of a term
            folded = data[at:end].translate(FOLDED)
            while end < len(data) and folded[-1:] != b" ":
                more = data[end:end + len(folded)].translate(FOLDED)
                cut = more.find(b" ")
                folded, end = (folded + more, end + len(more)) if cut < 0 else (folded + more[:cut + 1], end + cut + 1)
        else:
            folded = data[at:].translate(FOLDED)
        yield folded.split()
        at = end


def term_counts(data: bytes) -> Counter[bytes]:
    found: Counter[bytes] = Counter()
    for some in terms(data):
        found.update(some)
    return found


def index(df: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """The blocks of df: ids, lengths (long), n_docs (those with any term), n_terms, and the postings of the vocabulary's terms.

    terms and sizes are lists: a term's number, and how many documents of the block hold it; docs (places in the block, uint16)
    and counts (int32) are the postings themselves, one term after the other. A null text has no terms; repeated rows are
    documents of their own, and a null id is an id like any other.
    """
    df = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([
        ("ids", _arrow_list(df)), ("lengths", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("counts", pa.binary())])

    def block(ids: list[pa.Array], lengths: list[int], postings: list[tuple[int, int, int]]) -> pa.RecordBatch:
        table = np.array(postings, np.int64).reshape(-1, 3)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        found, sizes = np.unique(table[:, 0], return_counts=True)
        all_ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids), pa.array([np.array(lengths, np.int64).tobytes()]), pa.array([sum(x > 0 for x in lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64()),
            pa.array([found.tolist()], pa.list_(pa.int32())), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([table[:, 1].astype(np.uint16).tobytes()]), pa.array([table[:, 2].astype(np.int32).tobytes()]),
        ], schema=schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, postings = [], [], []
        for batch in slices(batches):
            taken = 0
            for row, data in enumerate(utf8(batch["text"])):
                if len(lengths) == DOCS_IN_BLOCK or len(postings) >= POSTINGS_IN_BLOCK:
                    ids.append(batch["id"].slice(taken, row - taken))
                    yield block(ids, lengths, postings)
                    ids, lengths, postings, taken = [], [], [], row
                found = term_counts(data)
                postings += [(vocabulary[t], len(lengths), found[t]) for t in found.keys() & vocabulary.keys()]
                lengths.append(found.total())
            ids.append(batch["id"].slice(taken))
        if lengths:
            yield block(ids, lengths, postings)

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(blocks, f"ids array<{kind}>, lengths binary, n_docs long, n_terms long, terms array<int>, sizes array<int>, docs binary, counts binary")


def _arrow_list(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.list_(to_arrow_type(df.schema["id"].dataType))


def sliced(docs: np.ndarray, impacts: np.ndarray, words: int) -> np.ndarray:
    """A row of words of 64 documents for each bit of the largest impact; docs ascend, impacts are theirs."""
    bits = int(impacts.max(initial=0)).bit_length()
    found = np.zeros((bits, words), np.uint64)
    if bits:
        word = docs >> 6
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        has = (impacts[None, :] >> np.arange(bits)[:, None]) & 1
        found[:, word[begins]] = np.add.reduceat(has.astype(np.uint64) << (docs & 63).astype(np.uint64)[None, :], begins, axis=1)
    return found


def added(numbers: list[np.ndarray], bits: int, words: int) -> np.ndarray:
    """The sum of sliced numbers, as bits slices, which must hold it."""
    parts = np.zeros((len(numbers), bits, words), np.uint64)
    for part, number in zip(parts, numbers):
        part[:len(number)] = number
    while len(parts) > 2:
        whole = len(parts) // 3
        x, y, z = (parts[k:3 * whole:3] for k in range(3))
        odd, rest = x ^ y, parts[3 * whole:]
        parts = np.zeros((2 * whole + len(rest), bits, words), np.uint64)
        parts[:whole] = odd ^ z
        parts[whole:2 * whole, 1:] = ((x & y) | (z & odd))[:, :-1]
        parts[2 * whole:] = rest
    if len(parts) < 2:
        return parts[0] if len(parts) else np.zeros((bits, words), np.uint64)
    (a, b), carry = parts, np.zeros(words, np.uint64)
    total = np.empty_like(a)
    for k in range(bits):
        odd = a[k] ^ b[k]
        total[k] = odd ^ carry
        carry = (a[k] & b[k]) | (odd & carry)
    return total


def places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(total: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k documents of highest score above 0 (all, if fewer), ties by order, and their scores."""
    sure, maybe = np.zeros(total.shape[1], np.uint64), np.bitwise_or.reduce(total, axis=0)
    for row in total[::-1]:
        have = maybe & row
        n = int(np.bitwise_count(sure | have).sum())
        if n > k:
            maybe = have
        else:
            sure |= have
            maybe &= ~row
            if n == k:
                break
    docs = places(sure)
    if len(docs) < k:
        tied = places(maybe)
        docs = np.concatenate([docs, tied[np.argsort(order[tied], kind="stable")][:k - len(docs)]])
    bits = (total[:, docs >> 6] >> (docs & 63).astype(np.uint64)[None, :]) & np.uint64(1)
    return docs, (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0)


class Statistics:
    """Of all documents: how many have terms, and how many terms there are; of each term its weight."""

    def __init__(self, n_docs: int, n_terms: int, df: dict[int, int]):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}

    def impacts(self, term: int, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m = 50 + (50 * lengths * self.n_docs) // self.n_terms
        return self.weights[term] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


def search(blocks: DataFrame, items: list[list[int]], names: pa.Array, statistics: Statistics, k: int) -> DataFrame:
    """(item_id, doc_id, score): of each block the k best documents for each item, which is a list of terms; names: the items' ids."""
    id_type = blocks.schema["ids"].dataType.elementType

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from in_block({c: batch[c][row] for c in batch.schema.names})

    def in_block(row: dict) -> Iterator[pa.RecordBatch]:
        ids, lengths = row["ids"].values, np.frombuffer(row["lengths"].as_py(), np.int64)
        docs, counts = np.frombuffer(row["docs"].as_py(), np.uint16).astype(np.int64), np.frombuffer(row["counts"].as_py(), np.int32).astype(np.int64)
        ends, at = np.cumsum(row["sizes"].as_py() or [0]), {t: k for k, t in enumerate(row["terms"].as_py())}
        words, order = -(-len(lengths) // 64), np.empty(len(lengths), np.int64)
        order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(lengths))
        cache: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0
        results: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, wanted in enumerate(items):
            numbers = []
            for t in wanted:
                if t not in at:
                    continue
                if t not in cache:
                    a, b = ends[at[t] - 1] if at[t] else 0, ends[at[t]]
                    cache[t] = sliced(docs[a:b], statistics.impacts(t, counts[a:b], lengths[docs[a:b]]), words)
                    held += cache[t].nbytes
                    while held > CACHE_BYTES and len(cache) > 1:
                        held -= cache.popitem(last=False)[1].nbytes
                cache.move_to_end(t)
                if len(cache[t]):
                    numbers.append(cache[t])
            if numbers:
                bits = sum((1 << len(x)) - 1 for x in numbers).bit_length()
                results.append((i, *best(added(numbers, bits, words), k, order)))
        if results:
            which = np.concatenate([np.full(len(d), i) for i, d, _ in results])
            where, scores = np.concatenate([d for _, d, _ in results]), np.concatenate([s for *_, s in results])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), ids.take(pa.array(where)), pa.array(scores)], names=["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import from_arrow_type

    return blocks.mapInArrow(found, f"item_id {from_arrow_type(names.type).simpleString()}, doc_id {id_type.simpleString()}, score long")


def passes(items: DataFrame) -> tuple[DataFrame, int]:
    """items with _pass, and how many there are: each has PASS_BYTES of text at most, or a single item."""
    n = 1
    while True:
        dealt = items.withColumn("_pass", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
        size = dealt.groupBy("_pass").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"), F.count_distinct(F.xxhash64("item_id")).alias("items"))
        most = size.where(F.col("items") > 1).agg(F.max("bytes")).first()[0] or 0
        if most <= PASS_BYTES:
            return dealt, n
        n *= max(2, most // PASS_BYTES)


def rank(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item (all, if fewer), ties by id, null first.

    Rows of items that share an id are one item with the terms of all of them, each once; a null id is an id like any other.
    Items and documents without terms, null texts too, are in no result. Repeated documents are documents of their own.
    Items go through the index in passes of bounded size, each of which indexes the terms of its own items; lengths, document
    frequencies and counts are always those of all documents. Empty tables give an empty table.
    """
    items, n_passes = passes(items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")))
    found: DataFrame | None = None
    for p in range(n_passes):
        part = items.where(F.col("_pass") == p).select("item_id", "text").toArrow()  # PASS_BYTES or one item
        wanted: dict = {}
        for row in part.to_pylist():
            wanted.setdefault(row["item_id"], Counter()).update(term_counts((row["text"] or "").encode()))
        vocabulary = {t: n for n, t in enumerate(sorted({t for x in wanted.values() for t in x}))}
        numbers = [sorted(vocabulary[t] for t in x) for x in wanted.values()]
        blocks = stored(index(docs, id_col, text_col, vocabulary))
        totals = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        df = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy("p.terms").agg(F.sum("p.sizes"))  # a row for each term of the vocabulary
        statistics = Statistics(totals[0] or 0, totals[1] or 0, dict(map(tuple, df.collect())))
        some = search(blocks, numbers, pa.array(list(wanted), part.schema.field("item_id").type), statistics, k)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
