"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is how many copies each of its documents should have; the whole part is certain, the
fraction is a probability. Two documents at a time, words of expected mass move at random from one to the other until one
of the probabilities is 0 or 1: each document keeps its expected copies, and a pair's words stay the same. A block of
documents leaves one fraction; the fractions of a source's blocks are blocks of the next level of a reduction tree, until
one is left for each source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import bounded_batches, cut_lineage, numbered, row_key, shuffle_partitions, slices, utf8

#: Documents in a block of the tree, about.
BLOCK_ROWS = 2048
WEIGHTS = (3, 1, 2)
TOTAL, MOST = 1.5, 2.0


def uniform(*parts: object) -> float:
    return xxhash.xxh64_intdigest(repr(parts).encode(), 9) / 2**64


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, n_docs, source_size, target) for every source of (source, size).

    Sources by code point, null last, weigh `weights` in turn and share `total` times all sizes; no target exceeds `most`
    times its source's size, and what is over goes to the others by weight. Per-source rows alone are numbered and summed:
    numbering goes by sorted ranges, of which only the counts come to the driver.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    per = numbered(per, "last", "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("ordinal", F.lit(len(weights))) + 1).cast("int"))
    table = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    rest, left, share, capped = None, None, None, -1
    while True:  # each round caps at least one more source, and all over the share at once
        over = F.lit(False) if share is None else F.col("most") <= F.col("weight") * share
        r = table.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)).alias("fixed"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("free"), F.count(F.when(over, 1)).alias("n")).first()
        if not r.free or r.n == capped:
            break
        capped, share = r.n, max(0.0, (r.all or 0) * total - r.fixed) / r.free
    target = F.col("most") if share is None else F.least("most", F.col("weight") * share)
    return table.select("source", "n_docs", "source_size", target.alias("target"))


def pivotal(rows: Iterator[tuple], level: int) -> Iterator[tuple[tuple, float]]:
    """(row, probability) with 0 or 1 for all rows but the last one, which is what the block leaves.

    rows: (size, probability, key, ...). Mass is size times probability. Which way it moves is a hash of both keys.
    """
    held, p = None, 0.0
    for row in rows:
        q = row[1]
        if held is None:
            held, p = row, q
            continue
        s, t = held[0], row[0]
        up, down = min(s - s * p, t * q), min(s * p, t - t * q)  # words that can move to the held row, and from it
        if uniform(level, held[2], row[2]) * (up + down) < down:
            move = up
        else:
            move = -down
        new_p, new_q = p + move / s, q - move / t
        # the end that was reached is set exactly
        if move > 0:
            new_p, new_q = (1.0, new_q) if s - s * p <= t * q else (new_p, 0.0)
        else:
            new_p, new_q = (0.0, new_q) if s * p <= t - t * q else (new_p, 1.0)
        if new_p in (0.0, 1.0):
            yield held, new_p
            held, p = row, new_q
            if p in (0.0, 1.0):
                yield held, p
                held = None
        else:
            yield row, new_q
            p = new_p
    if held is not None:
        yield held, p


def word_counts(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, k1, k2, size): words of each text, cut at ASCII white space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), pa.array([len(x.split()) for x in utf8(part.column("text"))], pa.int64())], names)

    rows = row_key(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "id", "text")
    kind = lambda c: rows.schema[c].dataType.simpleString()
    names = ["id", "source", "k1", "k2", "size"]
    return rows.mapInArrow(run, f"id {kind('id')}, source {kind('source')}, k1 long, k2 long, size long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """(id, source, k1, k2, size, source_size, target, copies) for every row; copies is 0, 1 or 2.

    The same rows give the same copies, however they are partitioned. A null text has size 0 and, like an empty one, the
    whole part of the copies that its source calls for. A null source is a source, the last. Repeated rows are rounded one
    by one. Sources whose documents are all empty have target 0. An empty table gives an empty one; other columns of df are
    not read. (k1, k2) identifies a row's id and text, for a join. A source of any size is dealt over many blocks.
    """
    bounded_batches(df)
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    # repeated rows are counted, and numbered anew, so that they are dealt over blocks like others and the same in every run
    alike = word_counts(df, id_col, text_col, source_col).groupBy("id", "source", "k1", "k2", "size").agg(F.count(F.lit(1)).alias("n"))
    sized = cut_lineage(alike.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n"))
    targets = source_targets(sized)
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"]), "left").select(sized["*"], "n_docs", "source_size", "target")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(wanted)).withColumn("p", wanted - F.col("whole"))
    rows = rows.withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK_ROWS)).withColumn("hash", F.xxhash64(F.lit(seed), "k1", "k2"))
    certain = (F.col("p") <= 0) | (F.col("size") <= 0)
    done = rows.where(certain).select("id", "source", "k1", "k2", "size", "source_size", "target", F.col("whole").alias("copies"))
    open_rows = rows.where(~certain)
    deepest = targets.agg(F.max("n_docs")).first()[0] or 0
    kind = lambda c: rows.schema[c].dataType.simpleString()
    columns = ["id", "source", "k1", "k2", "size", "source_size", "target", "whole", "p", "blocks", "hash", "nth"]
    schema = ", ".join(f"{c} {kind(c)}" for c in columns)
    level, out = 0, [done]
    while True:
        own = F.when(F.col("nth") == 0, F.xxhash64(F.lit(level), "hash", "k1")).otherwise(F.xxhash64(F.lit(level), "hash", "k1", "nth"))
        blocked = open_rows.withColumn("block", F.pmod(own, F.greatest("blocks", F.lit(1)))).select(*columns, "block")
        # large documents first: whichever of two alike settles, and what a block leaves at its end is a small one
        dealt = blocked.repartition(n, "source", "block").sortWithinPartitions("source", "block", F.desc("size"), "hash", "k1", "k2", "id", "nth", "p")

        def run(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            names = [*columns, "block"]

            def blocks() -> Iterator[list[tuple]]:
                key, held = None, []
                for batch in batches:
                    kinds[:] = [batch.column(c).type for c in columns]
                    for row in zip(*(batch.column(c).to_pylist() for c in names)):
                        if (row[1], row[-1]) != key:
                            if held:
                                yield held
                            key, held = (row[1], row[-1]), []
                        held.append(row)
                if held:
                    yield held

            for held in blocks():  # about BLOCK_ROWS rows each
                result = [(*row[:8], p, *row[9:12]) for row, p in ((r[3], p) for r, p in pivotal(((r[4], r[8], (seed, r[10], r[2], i), r) for i, r in enumerate(held)), level))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*result), kinds)], columns)

        kinds: list[pa.DataType] = []
        found = cut_lineage(dealt.mapInArrow(run, schema))
        settled = F.col("p").isin(0.0, 1.0)
        out.append(found.where(settled).select("id", "source", "k1", "k2", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies")))
        open_rows = found.where(~settled)
        if deepest <= BLOCK_ROWS ** (level + 1):
            break
        # blocks of the level before, each with one row at most, are this level's rows
        open_rows = open_rows.withColumn("blocks", F.ceil(F.col("blocks") / BLOCK_ROWS))
        level += 1
    # one fraction for each source at most: it is rounded alone
    chance = F.pmod(F.xxhash64(F.lit("last"), F.lit(seed), "hash", "nth"), F.lit(1 << 40)) / (1 << 40)
    out.append(open_rows.select("id", "source", "k1", "k2", "size", "source_size", "target", (F.col("whole") + (chance < F.col("p")).cast("long")).alias("copies")))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result.withColumnRenamed("id", id_col)


def apply(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows, each as often as the mix takes it; repeated rows of df (equal id and text) share the sum of their copies."""
    copies = mixed.groupBy("k1", "k2").agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    # packed, so that no column of df is called like those added here
    rows = row_key(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*df.columns).alias("_all")), "_id", "_text").drop("_id", "_text")
    alone = rows.join(copies, ["k1", "k2"])
    # of repeated rows one stands for all
    one = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(1)))
    taken = alone.withColumn("_row", one).where("_row = 1").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    return taken.select(*[F.col(f"_all.`{c}`").alias(c) for c in df.columns])
