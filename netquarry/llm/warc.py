"""WARC records and a Merkle fixity audit of replicas.

Records are laid out in files, in order. A record's hash is a leaf; a node's hash covers the hashes and lengths of its
children, and so an ordered range of offsets. Two replicas are compared at the root, and only branches that differ are
followed down to the damaged records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import cut_lineage, numbered

#: Children of a node, and records in a file (a power of it, so that no node up to a file's own crosses files).
FANOUT, RECORDS_IN_FILE = 16, 4096
DATE = "2024-01-01T00:00:00Z"


def record(url: Column, body: Column, date: str = DATE) -> Column:
    """The text of a WARC resource record; a null url or body counts as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"), F.sha2(F.concat(url, F.lit(" "), body), 256), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(header, body, F.lit("\r\n\r\n"))


def manifest(df: DataFrame, record_col: str, *order: str) -> DataFrame:
    """df without the records, but with ordinal, file, begin, end (offsets in the file) and sha256 of each record.

    Records are numbered in the given order, ties by hash. Only hashes and lengths are shuffled. A null record has length 0
    and the hash of nothing. Repeated rows are records of their own.
    """
    kept = [c for c in df.columns if c != record_col]
    body = F.coalesce(F.col(record_col), F.lit(""))
    rows = numbered(df.select(*kept, F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("sha256")), *order, "sha256")
    rows = rows.withColumn("file", F.floor(F.col("ordinal") / RECORDS_IN_FILE))
    upto = Window.partitionBy("file").orderBy("ordinal")  # RECORDS_IN_FILE rows
    return rows.withColumn("end", F.sum("bytes").over(upto)).withColumn("begin", F.col("end") - F.col("bytes")).drop("bytes")


def levels(leaves: DataFrame, n_leaves: int) -> list[DataFrame]:
    """The Merkle tree of (node, hash, bytes), leaves first, the root last; each level has (node, hash, bytes)."""
    out = [leaves.select("node", "hash", "bytes")]
    width = n_leaves
    while width > 1:
        children = F.array_sort(F.collect_list(F.struct("node", "hash", "bytes")))  # FANOUT at most
        below = out[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(children.alias("c"))
        covered = F.concat_ws("|", F.transform("c", lambda c: F.concat_ws(":", c["hash"], c["bytes"].cast("string"))))
        out.append(cut_lineage(below.select("node", F.sha2(covered, 256).alias("hash"), F.aggregate("c", F.lit(0).cast("long"), lambda n, c: n + c["bytes"]).alias("bytes"))))
        width = -(-width // FANOUT)
    return out


def differing_leaves(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """(node): leaves that differ, found from the roots down; children of equal nodes are never looked at."""
    bad: DataFrame | None = None
    for a, b in zip(reversed(one), reversed(other)):
        if bad is not None:
            a = a.join(bad.withColumnRenamed("node", "parent"), F.floor(F.col("node") / FANOUT) == F.col("parent"), "left_semi")
        pairs = a.alias("a").join(b.alias("b"), "node", "left").where(~F.col("a.hash").eqNullSafe(F.col("b.hash")) | ~F.col("a.bytes").eqNullSafe(F.col("b.bytes")))
        bad = cut_lineage(pairs.select("node"))
        if bad.isEmpty():
            break
    return bad


def audit(listed: DataFrame, replica: DataFrame) -> DataFrame:
    """listed (a manifest) with damaged: whether the replica's record of that ordinal has another hash or length, or lacks.

    replica has (ordinal, sha256, bytes); rows without an ordinal are left out, and of several of one ordinal the least
    hash counts. A record that only one side has is a leaf without a hash on the other; one that the manifest lacks comes
    back as a damaged row with the ordinal alone. If the roots agree, no other node is compared. Columns of listed called
    damaged are replaced. An empty manifest and an empty replica give an empty table.
    """
    listed = cut_lineage(listed.drop("damaged"))
    ours = listed.select(F.col("ordinal").alias("node"), F.col("sha256").alias("hash"), (F.col("end") - F.col("begin")).alias("bytes"))
    one = F.min(F.struct(F.col("sha256").alias("hash"), F.col("bytes").cast("long").alias("bytes"))).alias("r")
    theirs = replica.where(F.col("ordinal").isNotNull()).groupBy(F.col("ordinal").cast("long").alias("node")).agg(one).select("node", "r.hash", "r.bytes")
    both = cut_lineage(ours.alias("a").join(theirs.alias("b"), "node", "full_outer").select("node", *[F.coalesce(f"{t}.{c}", F.lit(d)).alias(f"{t}_{c}") for t in "ab" for c, d in (("hash", ""), ("bytes", 0))]))
    width = (both.agg(F.max("node")).first()[0] or 0) + 1
    trees = [levels(both.select("node", F.col(f"{t}_hash").alias("hash"), F.col(f"{t}_bytes").alias("bytes")), width) for t in "ab"]
    bad = differing_leaves(*trees).select(F.col("node").alias("ordinal"), F.lit(True).alias("_bad"))
    return listed.join(bad, "ordinal", "full_outer").withColumn("damaged", F.coalesce("_bad", F.lit(False))).drop("_bad")
