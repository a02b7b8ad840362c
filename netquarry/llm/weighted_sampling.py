"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: each word, without case, weighs the bytes that it covers in the text. For each of the
signature's places every weighted term draws gamma-distributed values that depend on the term alone; the term with the
smallest one and its quantised weight are the sample. Two signatures agree in a place with a probability that equals the
generalised Jaccard similarity: the sum of the smaller weights over the sum of the larger ones.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from netquarry.llm.common import bounded_batches, shuffle_partitions

PLACES = 64
#: Weighted terms whose draws are made at once.
TERMS_AT_ONCE = 1 << 14
#: Texts that are signed together: as many as have about this many bytes.
TOGETHER_BYTES = 2 << 20
_u64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> _u64(30))
    x *= _u64(0xBF58476D1CE4E5B9)
    x ^= x >> _u64(27)
    x *= _u64(0x94D049BB133111EB)
    x ^= x >> _u64(31)
    return x


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers in (0, 1) out of 64 bits."""
    scale = np.float32(2.0**-32)
    low, high = (x & _u64(0xFFFFFFFF)).astype(np.float32), (x >> _u64(32)).astype(np.float32)
    return np.clip(low * scale, 1e-9, 1 - 6e-8, out=low), np.clip(high * scale, 1e-9, 1 - 6e-8, out=high)


def draws(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each weighted term (rows) and place (columns) the value to minimise and the sample's 32 bits."""
    a, s = np.empty((len(terms), PLACES), np.float32), np.empty((len(terms), PLACES), np.uint32)
    places = mix(np.arange(1, PLACES + 1, dtype=np.uint64) * _u64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        for i in range(0, len(terms), TERMS_AT_ONCE):
            h = terms[i:i + TERMS_AT_ONCE, None] ^ places
            x = mix(h)
            u1, u2 = halves(x)
            r = -np.log(u1 * u2)  # gamma of shape 2
            u3, u4 = halves(mix(x + _u64(0x9E3779B97F4A7C15)))
            log_c = np.log(-np.log(u3 * u4))
            beta, _ = halves(mix(x + _u64(0x3C6EF372FE94F82A)))
            t = np.floor(np.log(weights[i:i + TERMS_AT_ONCE, None]) / r + beta)
            a[i:i + TERMS_AT_ONCE] = log_c - r * (t - beta + 1)
            s[i:i + TERMS_AT_ONCE] = (mix(h + t.astype(np.int64).view(np.uint64) * _u64(0xD1342543DE82EF95)) >> _u64(32)).astype(np.uint32)
    return a, s


def weights(text: str) -> dict[bytes, int]:
    """Word -> bytes it covers in the text; a text without words has the empty word."""
    return {w: n * len(w) for w, n in Counter(text.encode().lower().split()).items()} or {b"": 1}


def signatures(texts: list[str]) -> np.ndarray:
    """A row of PLACES samples for each text. Terms that texts share are drawn once."""
    number: dict[tuple[bytes, int], int] = {}
    members = [[number.setdefault(x, len(number)) for x in weights(text).items()] for text in texts]
    hashes: dict[bytes, int] = {}
    terms = np.array([hashes.get(w) or hashes.setdefault(w, xxhash.xxh64_intdigest(w, 17)) for w, _ in number], np.uint64)
    a, s = draws(terms, np.array([n for _, n in number], np.float32))
    out, column = np.empty((len(texts), PLACES), np.uint32), np.arange(PLACES)
    for i, m in enumerate(members):
        m = np.array(sorted(m, key=lambda k: terms[k]) if len(m) < 3 else m)
        out[i] = s[m[a[m].argmin(0)], column]
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The share of places in which two signatures agree: an estimate of the generalised Jaccard similarity."""
    return float((x == y).mean())


def hexadecimal(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text, its last half (rounded down, in code points) replaced by as many of the first of the following text."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every row, the signature in hexadecimal; one narrow pass.

    A null text counts as empty, as does one without words: both have the empty word's signature. Repeated rows and null
    ids come out as they came in; an empty table gives an empty one; other columns of df are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in together(zip(batch.column("id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()])):
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array([hexadecimal(x) for x in signatures(texts)])], ["id", "fingerprint"])

    bounded_batches(df)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def together(rows: Iterator[tuple]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for i, text in rows:
        ids.append(i)
        texts.append(text)
        size += len(text) + 1000
        if size >= TOGETHER_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, extra, id, text), partitioned by part and sorted, in which each part's last row (extra) is the next part's first.

    Ascending by id (null first), then text. Bounds are ids of the table, as many as there are shuffle partitions, so the row of
    a bound is the first of its part, and one copy of each such row is all that crosses parts; after the last comes the
    first. Texts are shuffled once.
    """
    n = shuffle_partitions(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"))
    found = rows.agg(F.min("key").alias("low"), F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("bounds")).first()
    bounds = sorted({found.low, *found.bounds}) if found.low is not None else []
    parts = len(bounds)
    table = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0))
    # the number of bounds at or below the key, by halving; bounds are a literal of at most as many numbers as partitions
    steps = F.array(*[F.lit(1 << i) for i in range(parts.bit_length(), -1, -1)])
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= parts) & (F.get(table, at + step - 1) <= F.col("key")), at + step).otherwise(at))
    placed = rows.withColumn("part", part - 1)
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))
    copies = F.when(F.get(table, F.col("part")) == F.col("key"), F.array(here, F.struct(F.pmod(F.col("part") - 1, F.lit(max(1, parts))).alias("part"), F.lit(True).alias("extra")))).otherwise(F.array(here))
    dealt = placed.select("id", "text", "key", F.explode(copies).alias("c")).select(F.col("c.part").alias("part"), F.col("c.extra").alias("extra"), "id", "key", "text")
    return dealt.repartitionById(max(1, parts), "part").sortWithinPartitions("part", "extra", "key", "text")


def with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the next row ascending by id (null first), then by text; after the last the first; a single row is
    its own next. A null text counts as empty. Equal ids, repeated rows and empty tables are fine (equal ids, and null ones,
    are in one part); other columns of df are not read. Ids are integers of any size, others are an error. Every part
    streams, a few texts at a time.
    """
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} has to hold integers, for the next document is the one with the next larger id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "id", "text"))):
                    yield row

        def pairs() -> Iterator[tuple]:
            held, done = None, None
            for part, extra, i, text in rows():
                if held is not None and held[0] == part:
                    yield held[1], held[2], text
                if not extra:
                    held = (part, i, text)
                elif part != done:  # copies of a bound's equal ids follow; the first is the next row
                    held, done = None, part

        def grouped() -> Iterator[list[tuple]]:
            out, size = [], 0
            for row in pairs():
                out.append(row)
                size += len(row[1]) + 1000
                if size >= TOGETHER_BYTES:
                    yield out
                    out, size = [], 0
            if out:
                yield out

        for group in grouped():
            texts = [t for _, t, _ in group]
            changed = [edited(t, f) for _, t, f in group]
            follows = [f for _, _, f in group]
            distinct = list(dict.fromkeys([*texts, *changed, *follows]))
            sign = dict(zip(distinct, signatures(distinct)))
            a, b, c = ([sign[t] for t in x] for x in (texts, changed, follows))
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _, _ in group], kind), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([hexadecimal(x) for x in a]), pa.array([hexadecimal(x) for x in b]),
                pa.array([likeness(x, y) for x, y in zip(a, b)]), pa.array([likeness(x, y) for x, y in zip(a, c)])], names)

    bounded_batches(df)
    dealt = with_next(df, id_col, text_col).select("part", "extra", "id", "text")
    schema = f"id {dealt.schema['id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[dealt.schema["id"].dataType.simpleString()]
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
