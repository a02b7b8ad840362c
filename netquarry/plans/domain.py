"""The benchmark tables seen as a netlist: which columns play nets, cells, implementations and signal traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators import dwell, hypergraph

#: 2024-01-01 in microseconds, and a day.
START, DAY = 1704067200000000, 86400000000
SHARE, RATIO, CAPACITY = 0.05, {0: 200, 1: 74, 2: 105}, [2000000, 740741, 1052632]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are nets, parts are cells."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_partkey").alias("node_id"))


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypergraph.distinct_pins(raw_pins(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.lit(1.0).alias("width"), ((F.col("o_orderkey") % 100) / 100.0).alias("entropy"))


def customer_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are nets: far more pins for each."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("edge_id"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("node_id")).join(orders, "l_orderkey").select("edge_id", "node_id")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three resources; every third part has a second implementation, every fifth one a third."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("int")
    zero = F.lit(0)
    some = [F.array(s, zero, zero), F.when(k % 3 == 0, F.array(zero, s * 2, zero)), F.when(k % 5 == 0, F.array(zero, zero, s * 3))]
    impls = F.filter(F.array(*some), lambda v: v.isNotNull())
    return table(spark, sf_dir, "part").select(k.alias("node_id"), impls.alias("impls")).withColumn("sel", (F.col("node_id") % F.size("impls")).cast("int"))


def assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % 2).cast("int").alias("part"))


def changes(spark: SparkSession, sf_dir: str, threshold: float = 100) -> DataFrame:
    """Users are one-bit signals, whether their events' values are over a threshold; errors are unknown."""
    v = F.when(F.col("event_type") == "error", "x").when(F.col("value") > threshold, "1").otherwise("0")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("signal"), F.lit(0).alias("bit"), (F.unix_micros(F.col("ts").cast("timestamp")) - START).alias("t"), F.col("event_id").alias("seq"), v.alias("v"))


def trace_end(spark: SparkSession, sf_dir: str) -> int:
    """The time of the last change: one number."""
    return changes(spark, sf_dir).agg(F.max("t")).first()[0] or 0


def held(spark: SparkSession, sf_dir: str, threshold: float = 100) -> DataFrame:
    return dwell.intervals(changes(spark, sf_dir, threshold), trace_end(spark, sf_dir))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-input LUTs whose inputs have smaller numbers: no loops."""
    k = F.col("p_partkey")
    name = lambda x: x.cast("string")
    return table(spark, sf_dir, "part").where("p_partkey >= 2").select(name(k).alias("wire"), (k % 16).cast("long").alias("init"), F.array(name(F.floor((k - 1) / 2)), name(F.floor((k - 2) / 3))).alias("inputs"))
