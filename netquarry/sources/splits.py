"""Text files read in splits of any size, with the same rows as from one.

What a split says hangs on the state in which a lexer comes to it: in a comment, in the middle of a statement. A split is
therefore lexed once for each state that there is; courses that have met go on as one. Its summary says for each state in
which one it ends. Summaries are composed over the splits of a file, FANOUT of them at a time, as in a parallel prefix, and
the states in which splits really begin come down the same way. Rows that belong to other states fall away.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.operators.tables import release, settle

#: Summaries that one task composes.
FANOUT = 1024

#: What a summary says for each state at the split's beginning: the state at its end, the unit that began what is then open
#: (-1: it was open before), what is kept of it, and the last time (null: none).
ENDS = "array<struct<state:int,open:bigint,held:string,time:bigint>>"
END_TYPE = pa.list_(pa.struct([("state", pa.int32()), ("open", pa.int64()), ("held", pa.string()), ("time", pa.int64())]))
_BEGIN = "file string, place long, block long, state int, open long, held string, time long, units_before long, bytes_before long"
_BEGIN_TYPE = pa.schema([("file", pa.string()), ("place", pa.int64()), ("block", pa.int64()), ("state", pa.int32()), ("open", pa.int64()), ("held", pa.string()), ("time", pa.int64()), ("units_before", pa.int64()), ("bytes_before", pa.int64())])
_SUMMARY_TYPE = pa.schema([("file", pa.string()), ("place", pa.int64()), ("block", pa.int64()), ("units", pa.int64()), ("bytes", pa.int64()), ("ends", END_TYPE)])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of all files at a path, in splits of the size that the session sets; a line belongs to the split in which it begins."""
    found = spark.read.option("lineSep", "\n").text(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))


def numbered_lines(spark: SparkSession, path: str, as_one: bool = False) -> DataFrame:
    """(file, line_no, value), from 0 on in each file: numbers within splits, plus the lines of the splits before.

    as_one: the files are the parts of one text, in the order of their names, and numbers go on from one to the next.
    Two scans, without Python: one counts, one reads. Both deal splits to tasks alike; a line that would show otherwise is an
    error.
    """
    rows = lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    spans = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy().orderBy("file", "block") if as_one else Window.partitionBy("file").orderBy("block")  # a row for each split
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = rows.join(spans.withColumn("before", before), ["file", "block"])
    local = F.col("at") - F.col("first")
    sound = F.when((local >= 0) & (local < F.col("n")), local).otherwise(F.raise_error(F.lit("splits were dealt anew between two scans")))
    return found.select("file", (F.col("before") + sound).alias("line_no"), "value")


def passed(start: dict, summary: dict) -> dict:
    """The state after a split that begins in a state."""
    end = summary["ends"][start["state"]]
    here = end["open"] >= 0
    return {
        "state": end["state"], "open": start["units_before"] + end["open"] if here else start["open"], "held": end["held"] if here else start["held"],
        "time": start["time"] if end["time"] is None else end["time"], "units_before": start["units_before"] + summary["units"], "bytes_before": start["bytes_before"] + summary["bytes"],
    }


#: The state at the beginning of a file.
INITIAL = {"state": 0, "open": -1, "held": None, "time": None, "units_before": 0, "bytes_before": 0}


def starts(summaries: DataFrame, time: int | None = None) -> DataFrame:
    """(file, block, state, open, held, time, units_before, bytes_before): how each split of summaries(file, block, units, bytes, ends) begins.

    open counts units from the file's beginning on; time is what holds at a file's beginning.
    """
    by_place = Window.partitionBy("file").orderBy("block")  # a row for each split
    level = settle(summaries.select("file", (F.row_number().over(by_place) - 1).cast("long").alias("place"), "block", "units", "bytes", "ends"))
    levels, most = [level], level.agg(F.max("place")).first()[0] or 0
    while most >= FANOUT:
        levels.append(settle(_grouped(levels[-1]).applyInArrow(_composed, f"file string, place long, block long, units long, bytes long, ends {ENDS}")))
        most //= FANOUT
    first = INITIAL | {"time": time}

    def from_the_top(rows: pa.Table) -> pa.Table:
        return _walked(rows, first)

    def from_above(rows: pa.Table, above: pa.Table) -> pa.Table:
        return _walked(rows, above.to_pylist()[0])

    found = settle(levels[-1].groupBy("file").applyInArrow(from_the_top, _BEGIN))
    for level in reversed(levels[:-1]):
        found = settle(_grouped(level).cogroup(found.groupBy("file", F.col("place").alias("part"))).applyInArrow(from_above, _BEGIN))
    release(*levels)
    return found.drop("place")


def _grouped(level: DataFrame):
    return level.groupBy("file", F.floor(F.col("place") / FANOUT).alias("part"))


def _composed(rows: pa.Table) -> pa.Table:
    """The summary of consecutive splits of a file."""
    rows = rows.sort_by("place").to_pylist()
    ends = []
    for state in range(len(rows[0]["ends"])):
        now = INITIAL | {"state": state}
        for row in rows:
            now = passed(now, row)
        ends.append({k: now[k] for k in ("state", "open", "held", "time")})
    whole = {"file": rows[0]["file"], "place": rows[0]["place"] // FANOUT, "block": rows[0]["block"], "units": sum(r["units"] for r in rows), "bytes": sum(r["bytes"] for r in rows), "ends": ends}
    return pa.Table.from_pylist([whole], schema=_SUMMARY_TYPE)


def _walked(rows: pa.Table, start: dict) -> pa.Table:
    found, now = [], start
    for row in rows.sort_by("place").to_pylist():
        found.append({"file": row["file"], "place": row["place"], "block": row["block"]} | {k: now[k] for k in ("state", "open", "held", "time", "units_before", "bytes_before")})
        now = passed(now, row)
    return pa.Table.from_pylist(found, schema=_BEGIN_TYPE)


def in_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, block), line), in order."""
    for batch in batches:
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
            yield (file, block), value or ""


def resolved(found: DataFrame, begin: DataFrame) -> DataFrame:
    """The rows of found(file, block, starts, ...) that the real states of the splits let stand, with the columns of starts().

    starts is a bit mask of the states at the split's beginning that give the row.
    """
    names = {c: f"begin_{c}" for c in ("state", "open", "held", "time")}
    joined = found.join(begin.withColumnsRenamed(names), ["file", "block"])
    return joined.where(F.getbit(F.col("starts").cast("long"), F.col("begin_state")) == 1)
