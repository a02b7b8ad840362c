"""Graphs in XML: node, edge and port elements as a netlist, read in splits by Spark's XML source with the schema of the grammar."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of the elements (fixed values).
NODE = "name string, resource_weights struct<lut_factor:int,dsp_factor:int,bram_factor:int>, source_edges struct<name:array<string>>, sink_edges struct<name:array<string>>"
EDGE = "name string, weight double"
PORT = "name string, source_edge string, sink_edge string"


def elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").schema(schema).option("rowTag", tag).option("mode", "FAILFAST").load(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes (node_id, name, impls, sel), pins (edge_id, node_id), edges (edge_id, width, entropy, name)) of all graphs at a path.

    Ids are hashes of names. A node without weights weighs nothing; ports are nodes of no weight. A node's or port's edge that
    the graph doesn't declare is an error, raised when the pins are computed. A pin stands once, whatever its direction.
    """
    nodes, ports = elements(spark, path, "node", NODE), elements(spark, path, "port", PORT)
    edges = elements(spark, path, "edge", EDGE).select(F.xxhash64("name").alias("edge_id"), F.col("weight").alias("width"), F.lit(1.0).alias("entropy"), "name")
    weight = F.array(*[F.coalesce(F.col(f"resource_weights.{c}"), F.lit(0)) for c in ("lut_factor", "dsp_factor", "bram_factor")])
    none = F.array(F.lit(0), F.lit(0), F.lit(0))
    empty = F.array().cast("array<string>")
    names = F.concat(F.coalesce("source_edges.name", empty), F.coalesce("sink_edges.name", empty))
    every = nodes.select("name", weight.alias("weight"), names.alias("edges")).unionByName(
        ports.select("name", none.alias("weight"), F.filter(F.array("source_edge", "sink_edge"), lambda e: e.isNotNull()).alias("edges")))
    found = every.select(F.xxhash64("name").alias("node_id"), F.explode("edges").alias("edge")).distinct()
    joined = found.join(edges.select("edge_id", F.col("name").alias("edge")), "edge", "left")
    declared = F.coalesce("edge_id", F.raise_error(F.concat(F.lit("no such edge: "), "edge")).cast("long"))
    return every.select(F.xxhash64("name").alias("node_id"), "name", F.array("weight").alias("impls"), F.lit(0).alias("sel")), joined.select(declared.alias("edge_id"), "node_id"), edges


def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's lines as a document of its own."""
    end = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], ["value"])
    yield end("<graph>")
    yield from batches
    yield end("</graph>")


def lines(nodes: DataFrame, pins: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): an element a line for each of nodes(node_id, name, weight) with its pins(edge, node_id) and of edges(name, width).

    Each partition is a document, so that it can be written by tasks of its own; read() takes them together. Names are to hold
    no markup.
    """
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    of = pins.groupBy("node_id").agg(F.array_sort(F.collect_list("edge")).alias("e"))  # a node's nets
    weights = F.concat(*[tag(t, F.get("weight", F.lit(i)).cast("string")) for i, t in enumerate(("lut_factor", "dsp_factor", "bram_factor"))])
    ends = F.coalesce(F.array_join(F.transform("e", lambda e: tag("name", e)), ""), F.lit(""))
    node = tag("node", F.concat(tag("name", F.col("name")), tag("resource_weights", weights), tag("source_edges", ends)))
    edge = tag("edge", F.concat(tag("name", F.col("name")), tag("weight", F.col("width").cast("string"))))
    return nodes.join(of, "node_id", "left").select(node.alias("value")).unionByName(edges.select(edge.alias("value"))).mapInArrow(framed, "value string")
