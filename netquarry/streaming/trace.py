"""Dwell times of live traces: Structured Streaming with state by signal, and the same on a finished table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netquarry.operators import tables
from netquarry.plans import domain as D

STATES = "01xz"


def advance(state: tuple[int, str, int, int, int, int], changes: list[tuple[int, int, str]]) -> tuple[int, str, int, int, int, int]:
    """(time of the last change, value, n0, n1, nx, nz) after more changes (t, seq, v); what is late counts for nothing."""
    t0, v0, *n = state
    for t, _, v in sorted(changes):
        if t >= t0:
            n[STATES.index(v0)] += t - t0
            t0, v0 = t, v
    return t0, v0, *n


def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One signal's part of a micro-batch; gives its totals so far."""
    now = state.get if state.exists else (0, "x", 0, 0, 0, 0)
    batch: list[tuple[int, int, str]] = []  # chunks come in any order of time
    for f in frames:
        batch += zip(f["t"].tolist(), f["seq"].tolist(), f["v"].tolist())
    now = advance(now, batch)
    state.update(now)
    yield pd.DataFrame({"signal": [key[0]], "last_t": [now[0]], "value": [now[1]], "n0": [now[2]], "n1": [now[3]], "nx": [now[4]], "nz": [now[5]]})


def live_dwell(changes: DataFrame) -> DataFrame:
    """Streaming changes (signal, t, seq, v) to a stream of totals by signal, in update mode."""
    schema = "signal string, last_t long, value string, n0 long, n1 long, nx long, nz long"
    state = "t0 long, v0 string, n0 long, n1 long, nx long, nz long"
    return changes.select("signal", "t", "seq", "v").groupBy("signal").applyInPandasWithState(update, schema, state, "update", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Streaming events (ts, signal, v) to counts of changes in tumbling windows; late rows beyond the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "v").agg(F.count("*").alias("n"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, v, n): the events table through the windowed operator, changes by day and value.

    The stream is the whole table in one batch, so that nothing in it is late; windows come out as they stand at its end.
    """
    schema = D.table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.[p]arquet")  # a pattern names a file as well as a folder
    v = F.when(F.col("event_type") == "error", "x").when(F.col("value") > 100, "1").otherwise("0")
    rows = files.select(F.col("ts").cast("timestamp").alias("ts"), v.alias("v"))
    place = f"{tables.shared_folder(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"
    sink = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{place}/out")
    q = windows(rows).writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{place}/out").groupBy("window", "v").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"), "v", "n")


def stream_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table through the streaming operator, then the last values held up to the trace's end, as the batch does."""
    schema = D.table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.[p]arquet")  # a pattern names a file as well as a folder
    v = F.when(F.col("event_type") == "error", "x").when(F.col("value") > 100, "1").otherwise("0")
    changes = files.select(F.col("user_id").cast("string").alias("signal"), (F.unix_micros(F.col("ts").cast("timestamp")) - D.START).alias("t"), F.col("event_id").alias("seq"), v.alias("v"))
    shared = tables.shared_folder(spark).rstrip("/")
    place = f"{shared}/stream-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    sink = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{place}/out")
    q = live_dwell(changes).writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    end = D.trace_end(spark, sf_dir)
    last = spark.read.parquet(f"{place}/out").groupBy("signal").agg(F.max_by(F.struct("last_t", "value", "n0", "n1", "nx", "nz"), "batch").alias("s"))
    rest = lambda s: (F.col(f"s.n{s}") + F.when(F.col("s.value") == s, end - F.col("s.last_t")).otherwise(0)).alias(f"n{s}")
    return last.select("signal", F.lit(0).alias("bit"), *[rest(s) for s in STATES])
