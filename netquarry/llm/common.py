"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker holds as Python objects at once (a longer single text still goes through whole).
SLICE_BYTES = 2 << 20


#: Rows of a small table that one task writes.
ROWS_IN_FILE = 100_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the cluster's shared folder.

    Where the session names none, a local session, as in tests, gets one on this machine; on a cluster it is an error, since
    executors don't share one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named := tempfile.mkdtemp(prefix="netquarry-checkpoint-"))
    return named


def in_few_files(df: DataFrame, rows: int | None) -> DataFrame:
    """rows: at most how many rows df has, where that is known and its last stage is light; a small table then comes in few
    files, for each costs every reader a task and the writer a file's creation."""
    if rows is not None and (files := rows // ROWS_IN_FILE + 1) < shuffle_partitions(df.sparkSession):
        return df.coalesce(files)
    return df


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written as Parquet to a folder of its own in the shared folder and read from there; the caller's cluster clears that folder.

    Unlike a checkpoint it has the size that its files have. A checkpoint keeps the optimiser's estimate, which in rounds of
    joins grows to numbers of millions of digits.
    """
    place = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    in_few_files(df, rows).write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written eagerly to the shared folder as a checkpoint and read from there; rows as in in_few_files()."""
    shared_folder(df.sparkSession)
    return in_few_files(df, rows).checkpoint(eager=True)


#: Bytes of a batch between Spark and its Python workers, where the session leaves Spark's default.
BATCH_BYTES, _BYTES, _DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bounded_batches(df: DataFrame) -> None:
    """Makes the session's Arrow batches smaller than Spark's default, which several tasks of an executor hold several times.

    The setting is read when a plan runs, which is after an operator has returned, so it stays; a session that has set it
    to anything else keeps its own.
    """
    conf = df.sparkSession.conf
    if str(conf.get(_BYTES, None)).lower().removesuffix("b") in ("none", str(_DEFAULT), "64m"):
        conf.set(_BYTES, str(BATCH_BYTES))


_memos: dict[str, Callable[[], None]] = {}


def only_memo(name: str, clear: Callable[[], None]) -> None:
    """Says that a worker's memo is in use: those of other operators, which ran in the same worker before, are cleared."""
    for other in [k for k in _memos if k != name]:
        _memos.pop(other)()
    _memos[name] = clear


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their texts have about limit bytes each; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, size
        pa.default_memory_pool().release_unused()  # a worker goes on to live beside others


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def from_buffer(parts: list[bytes], dtype: type[np.generic]) -> pa.ListArray:
    """A list<int> column out of the rows' packed integers."""
    data = np.frombuffer(b"".join(parts), dtype)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // np.dtype(dtype).itemsize
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(data))


def row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds k1 and k2, 128 bits that stand for (id, text); equal rows have equal keys, and a null id is an id like any other."""
    return df.withColumns({
        "k1": F.xxhash64(F.col(id_col).isNull(), id_col, text_col),
        "k2": F.xxhash64(F.lit("second"), F.col(id_col).isNull(), id_col, text_col),
    })


def numbered(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """df with the place of each row in the given order, from 0 on; rows that are equal in it come in any order.

    Rows are dealt by range, sorted and written to the shared folder; only the partitions' row counts come to the driver.
    """
    at = F.col("_place")
    placed = cut_lineage(
        df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    before, offsets = 0, [F.lit(-1), F.lit(0)]
    for p, n in sorted(placed.groupBy(F.shiftright(at, 33).alias("p")).count().collect()):
        offsets += [F.lit(p), F.lit(before)]
        before += n
    start = F.create_map(*[x.cast("long") for x in offsets])[F.shiftright(at, 33)]
    return placed.withColumn(name, start + at.bitwiseAND((1 << 33) - 1)).drop("_place")


#: Rows of one group that are joined with their group's figures under one key.
SPAN = 1 << 16


def numbered_within(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with _first (a number for each group, ascending with it, null first), _width (rows of the group) and _place (from 0 on, in the given order).

    Rows that are equal in the order come in any order. A group of any size is dealt over tasks: rows are numbered over the
    whole table, and figures of groups are joined by group and span of SPAN rows.
    """
    tied = stored(df).withColumn("_tie", F.monotonically_increasing_id())
    rows = numbered(tied, group, *order, "_tie", name="_row").drop("_tie").withColumn("_span", F.floor(F.col("_row") / SPAN))
    spans = rows.groupBy(F.col(group).alias("_group"), "_span").agg(F.min("_row").alias("_least"), F.count(F.lit(1)).alias("_n"))
    groups = spans.groupBy(F.col("_group").alias("_same")).agg(F.min("_least").alias("_first"), F.sum("_n").alias("_width"))
    spans = spans.join(groups, F.col("_group").eqNullSafe(F.col("_same"))).select("_group", F.col("_span").alias("_of"), "_first", "_width")
    found = rows.join(spans, (F.col("_span") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.withColumn("_place", F.col("_row") - F.col("_first")).drop("_row", "_span", "_of", "_group")
