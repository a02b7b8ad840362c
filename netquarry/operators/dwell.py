"""Time-weighted states of bits: value_changes(signal, bit, t, seq, v) with v one of 0, 1, x, z."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions import names, probability

STATES = ("0", "1", "x", "z")


def intervals(changes: DataFrame, end: int, start: int = 0) -> DataFrame:
    """(signal, bit, v, t0, t1): how long each value holds. A bit is x from the start to its first change; the last value holds up to the end.

    The start is a row of its own for each bit, made by the aggregate that also finds the bits.
    """
    bits = changes.groupBy("signal", "bit").agg(F.lit(start).cast("long").alias("t"), F.lit(-1).cast("long").alias("seq"), F.lit("x").alias("v"))
    rows = changes.select("signal", "bit", "t", "seq", "v").unionByName(bits)
    order = Window.partitionBy("signal", "bit").orderBy("t", "seq")
    held = rows.withColumn("t1", F.coalesce(F.lead("t").over(order), F.lit(end)))
    return held.select("signal", "bit", "v", F.col("t").alias("t0"), "t1").where("t1 > t0")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    length = F.col("t1") - F.col("t0")
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("v") == s, length)), F.lit(0)).cast("long").alias(f"n{s}") for s in STATES])


def dwell(held: DataFrame) -> DataFrame:
    """(signal, bit, n0, n1, nx, nz)"""
    return _sums(held, "signal", "bit")


def sliced(held: DataFrame, width: int, start: int = 0) -> DataFrame:
    """(signal, bit, slice, n0, n1, nx, nz): intervals are cut at the slices' bounds, however many they span."""
    at = lambda t: F.floor((t - start) / width).cast("long")
    cut = held.withColumn("slice", F.explode(F.sequence(at(F.col("t0")), at(F.col("t1") - 1))))
    low = F.col("slice") * width + start
    return _sums(cut.withColumn("t0", F.greatest("t0", low)).withColumn("t1", F.least("t1", low + width)), "signal", "bit", "slice")


def entropies(counts: DataFrame, *keys: str) -> DataFrame:
    """keys and h, the minimal entropy."""
    return counts.select(*keys, F.round(probability.min_entropy(F.col("n0"), F.col("n1"), F.col("nx"), F.col("nz")), 9).alias("h"))


def slice_totals(slices: DataFrame) -> DataFrame:
    """(slice, n_signals, total, mean) over all signals."""
    h = probability.min_entropy(F.col("n0"), F.col("n1"), F.col("nx"), F.col("nz"))
    return slices.withColumn("h", h).groupBy("slice").agg(F.count("*").alias("n_signals"), F.round(F.sum("h"), 6).alias("total"), F.round(F.avg("h"), 6).alias("mean"))


def matched(gold: DataFrame, other: DataFrame) -> DataFrame:
    """other(signal, h) with its gold value: by name, else by the escaped name. Columns signal, gold_signal, gold_h, h."""
    by_name = gold.select(F.col("signal").alias("g1"), F.col("h").alias("h1"))
    by_escape = gold.select(F.col("signal").alias("g2"), F.col("h").alias("h2"))
    both = other.join(by_name, F.col("signal") == F.col("g1"), "left").withColumn("escaped", names.escape(F.col("signal"))).join(by_escape, F.col("escaped") == F.col("g2"), "left")
    return both.select("signal", F.coalesce("g1", "g2").alias("gold_signal"), F.coalesce("h1", "h2").alias("gold_h"), "h")


def compare(gold: DataFrame, other: DataFrame) -> DataFrame:
    """(signal, diff, abs_diff) of the signals that pair, under their gold names."""
    d = F.round(F.col("h") - F.col("gold_h"), 9)
    return matched(gold, other).where("gold_signal IS NOT NULL").select(F.col("gold_signal").alias("signal"), d.alias("diff"), F.abs(d).alias("abs_diff"))


def unmatched(gold: DataFrame, other: DataFrame) -> DataFrame:
    """One row: matched, gold_only, other_only."""
    pairs = matched(gold, other)
    n = pairs.agg(F.count("gold_signal").alias("matched"), F.count(F.when(F.col("gold_signal").isNull(), 1)).alias("other_only"))
    alone = gold.join(pairs.where("gold_signal IS NOT NULL").select("gold_signal"), F.col("signal") == F.col("gold_signal"), "left_anti").agg(F.count("*").alias("gold_only"))
    return n.crossJoin(alone).select("matched", "gold_only", "other_only")  # two single rows


def whitelisted(signals: DataFrame, whitelist: DataFrame | None) -> DataFrame:
    """Signals on the list; no list keeps all."""
    return signals if whitelist is None else signals.join(whitelist.select("signal").distinct(), "signal", "left_semi")


#: Lower bounds of the entropy bins (fixed values); the last bin has the rest.
BINS = (0.99, 0.95, 0.9, 0.75, 0.5, 0.25, 0.1)


def entropy_bins(values: DataFrame) -> DataFrame:
    """(bin, n, percent) of h."""
    which = F.when(F.col("h") >= BINS[0], 1)
    for i, low in enumerate(BINS[1:], 2):
        which = which.when(F.col("h") >= low, i)
    by = values.groupBy(which.otherwise(len(BINS) + 1).alias("bin")).agg(F.count("*").alias("n"))
    return by.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row for each bin
