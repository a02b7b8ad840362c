"""Signal probability and entropy, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(p: Column) -> Column:
    """Shannon entropy of a bit in [0, 1]; 0 where p is 0, 1 or outside."""
    q = 1 - p
    h = -p * F.log2(p) - q * F.log2(q)
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))


def bus_entropy(bits: Column) -> Column:
    return F.aggregate(F.transform(bits, entropy), F.lit(0.0), lambda a, h: a + h)


def share(n: Column, total: Column) -> Column:
    """n / total, 0 where the total is 0."""
    return F.when(total == 0, 0.0).otherwise(n / total)


def min_entropy(n0: Column, n1: Column, nx: Column, nz: Column) -> Column:
    """Entropy with unknown and floating time given to the more frequent of 0 and 1 (to 0 where they are equal)."""
    total, rest = n0 + n1 + nx + nz, nx + nz
    return entropy(share(F.when(n1 > n0, n1 + rest).otherwise(n1), total))


def biased_p1(n0: Column, n1: Column, nx: Column, nz: Column) -> Column:
    """Probability of 1 with unknown and floating time given to 1 only where 1 leads clearly (by a tenth)."""
    return share(F.when(n1 > 1.1 * n0, n1 + nx + nz).otherwise(n1), n0 + n1 + nx + nz)


def lut(inputs: Column, init: Column) -> Column:
    """Probability of 1 of a look-up table: the sum over the minterms whose INIT bit is 1; input i is bit i of the minterm.

    init is a long, as a bit pattern; there are six inputs at most.
    """
    minterms = F.sequence(F.lit(0), F.least(F.lit(63), (F.pow(F.lit(2), F.greatest(F.size(inputs), F.lit(0))) - 1).cast("int")))

    def term(m: Column) -> Column:
        return F.aggregate(F.transform(inputs, lambda p, i: F.when(bit(m, i) == 1, p).otherwise(1 - p)), F.lit(1.0), lambda a, x: a * x)

    used = F.filter(minterms, lambda m: bit(init, m) == 1)
    return F.aggregate(F.transform(used, term), F.lit(0.0), lambda a, x: a + x)


def bit(mask: Column, place: Column) -> Column:
    """The bit of a long at a place."""
    return F.call_function("getbit", mask.cast("long"), place.cast("int")).cast("int")


def mux(select: Column, i0: Column, i1: Column) -> Column:
    return select * i1 + (1 - select) * i0


def xor(p: Column, q: Column) -> Column:
    return p * (1 - q) + q * (1 - p)


def carry_chain(carry_in: Column, data: Column, select: Column) -> Column:
    """Array of structs (co, o) by bit: co = s ? carry : data, o = s xor carry, the carry going from bit to bit."""
    empty = F.array().cast("array<struct<co:double,o:double>>")
    start = F.struct(carry_in.cast("double").alias("c"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        co = x["s"] * acc["c"] + (1 - x["s"]) * x["d"]
        return F.struct(co.alias("c"), F.concat(acc["out"], F.array(F.struct(co.alias("co"), xor(x["s"], acc["c"]).alias("o")))).alias("out"))

    return F.aggregate(F.zip_with(data, select, lambda d, s: F.struct(d.cast("double").alias("d"), s.cast("double").alias("s"))), start, step)["out"]

