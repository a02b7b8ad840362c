"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for each row.

A node is a digest in hexadecimal; FANOUT consecutive nodes, the last run of a level maybe fewer, become the digest of
their concatenation. Rows are dealt in aligned blocks of FANOUT ** LEVELS leaves. A block's digests are a contiguous matrix
of 64 bytes a row: reshaped by the fanout its rows are hashed level by level, and a node's siblings are found by index
alone. The blocks' top nodes are the leaves of the next round, up to the root; proofs go down the same rounds.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import numbered_within, stored

#: Children of a node, and levels that a block of leaves goes up in one round.
FANOUT, LEVELS = 8, 4
BLOCK = FANOUT ** LEVELS
HEX = 64


def leaf(*columns: Column) -> Column:
    """The digest of a row: of each column `-` if it is null, else its bytes in UTF-8, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]), 256)


def folded(start: Column, lefts: Column, rights: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings, level by level: the check of a proof."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def digests(hashes: pa.ChunkedArray) -> np.ndarray:
    """A matrix with a row of HEX bytes for each digest."""
    return np.array(hashes.cast(pa.binary()).to_pylist(), f"S{HEX}").view(np.uint8).reshape(-1, HEX)


def above(nodes: np.ndarray) -> np.ndarray:
    """The next level: whole runs are rows of the reshaped matrix, the last run may be shorter."""
    whole = len(nodes) // FANOUT
    found = [sha256(run).hexdigest().encode() for run in nodes[:whole * FANOUT].reshape(whole, FANOUT * HEX)]
    if whole * FANOUT < len(nodes):
        found.append(sha256(nodes[whole * FANOUT:]).hexdigest().encode())
    return np.frombuffer(b"".join(found), np.uint8).reshape(-1, HEX)


def levels(nodes: np.ndarray, width: int) -> list[np.ndarray]:
    """A block's levels, its leaves first; width: the nodes of the whole tree on the leaves' level. A tree ends at one node."""
    found = [nodes]
    while width > 1 and len(found) <= LEVELS:
        found.append(above(found[-1]))
        width = -(-width // FANOUT)
    return found


def siblings(found: list[np.ndarray], place: int) -> tuple[list[bytes], list[bytes]]:
    """On each of a block's levels but the last the digests left and right of the leaf's ancestor within its run."""
    lefts, rights = [], []
    for level in found[:-1]:
        run = place - place % FANOUT
        lefts.append(level[run:place].tobytes())
        rights.append(level[place + 1:run + FANOUT].tobytes())
        place //= FANOUT
    return lefts, rights


def _block() -> Column:
    return F.floor(F.col("place") / BLOCK).alias("block")


def tops(nodes: DataFrame) -> DataFrame:
    """(tree, width, place, hash) of the level that is LEVELS higher, or a tree's root if that comes first."""

    def top(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        width, place = block["width"][0].as_py(), block["place"][0].as_py()
        last = levels(digests(block["hash"]), width)[-1]
        return pa.table({"tree": [block["tree"][0].as_py()], "width": [-(-width // BLOCK)], "place": [place // BLOCK], "hash": [last.tobytes().decode()]})

    return nodes.select("tree", "width", "place", "hash").groupBy("tree", _block()).applyInArrow(top, "tree long, width long, place long, hash string")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """nodes and the rounds above them, until every tree is one node; each has (tree, width, place, hash)."""
    found, widest = [nodes], nodes.agg(F.max("width")).first()[0] or 0
    while widest > 1:
        found.append(stored(tops(found[-1]), rows=widest))
        widest = -(-widest // BLOCK)
    return found


def proofs(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """nodes with lefts and rights, their siblings on all levels up to the root.

    upper: (tree, place) of the nodes' block, its own lefts and rights and other columns, which the nodes come to have. A
    block and its one row of upper are a group of at most BLOCK + 1 rows.
    """
    added = [f for f in upper.schema.fields if f.name not in ("tree", "place", "lefts", "rights")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in [*nodes.schema.fields, *added]] + ["lefts array<string>", "rights array<string>"])
    names, extra = nodes.columns, [f.name for f in added]

    def proven(block: pa.Table, above_it: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        found = levels(digests(block["hash"]), block["width"][0].as_py())
        higher = {c: above_it[c][0].as_py() for c in ("lefts", "rights", *extra)}
        sides = [siblings(found, i) for i in range(block.num_rows)]
        columns = {c: block[c] for c in names} | {c: [higher[c]] * block.num_rows for c in extra}
        for k, side in enumerate(("lefts", "rights")):
            columns[side] = pa.array([[x.decode() for x in s[k]] + higher[side] for s in sides], pa.list_(pa.string()))
        return pa.table(columns)

    below = nodes.groupBy(F.col("tree"), _block())
    return below.cogroup(upper.groupBy(F.col("tree"), F.col("place").alias("block"))).applyInArrow(proven, schema)


def manifest(df: DataFrame, group_col: str, *order: str, leaf_col: str = "leaf") -> DataFrame:
    """df with subroot (of the row's group), root (of all), lefts and rights: the row's siblings from its leaf to the root.

    df has a digest for each row in leaf_col. Rows are in one tree for each value of group_col (null is a value, the first
    one), in the given order (nulls first, ties by digest; rows equal in all of it come in any order, which changes no
    node); the groups' roots, in their order, are the leaves of the last tree. A group of one row has its leaf for a root.
    Repeated rows are leaves of their own. No columns of df may be called tree, width, place, hash, subroot, root, lefts or
    rights. Rows are shuffled without texts if df has none. An empty table gives an empty table.
    """
    kept = df.columns
    placed = numbered_within(df, group_col, *order, leaf_col).withColumnsRenamed({"_first": "tree", "_width": "width", "_place": "place"})
    nodes = stored(placed.withColumn("hash", F.col(leaf_col)))
    if nodes.isEmpty():
        return nodes.select(*kept, *[F.lit("").alias(c) for c in ("subroot", "root")], *[F.array().cast("array<string>").alias(c) for c in ("lefts", "rights")])
    below = rounds(nodes)
    groups = numbered_within(below[-1].select("hash", F.col("tree").alias("group"), F.lit(0).cast("long").alias("all")), "all", "group")
    roots = rounds(stored(groups.select(F.lit(0).cast("long").alias("tree"), F.col("_width").alias("width"), F.col("_place").alias("place"), "hash", "group")))
    nothing = F.array().cast("array<string>")
    up = roots[-1].select("tree", "place", F.col("hash").alias("root"), nothing.alias("lefts"), nothing.alias("rights"))
    for level in reversed(roots[:-1]):
        up = proofs(level, up).drop("width", "hash") if "group" not in level.columns else proofs(level, up).drop("width").withColumnRenamed("hash", "subroot")
    if len(roots) == 1:  # one group alone: its root is the root of all
        up = roots[0].select("tree", "place", "group", F.col("hash").alias("subroot"), F.col("hash").alias("root"), nothing.alias("lefts"), nothing.alias("rights"))
    up = up.select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("place"), "subroot", "root", "lefts", "rights")
    for level in reversed(below[:-1]):
        up = proofs(level, up).drop("width", "hash") if level is not nodes else proofs(level, up)
    if len(below) == 1:  # every group is one row
        up = nodes.join(up.drop("place"), "tree")
    return up.select(*kept, "subroot", "root", "lefts", "rights")
