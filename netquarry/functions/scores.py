"""Balance and ratio scores over weight arrays, one element a resource; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of the allowed imbalance from which a resource counts as near violation, and the factor its score then gets.
NEAR, NEAR_FACTOR, RATIO_SIGNIFICANCE = 0.80, 16, 10.0


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def relative_imbalance(balance: Column, allowed: Column) -> Column:
    """|balance| / allowed by resource; an allowance of 0 counts as 1."""
    return F.zip_with(balance, allowed, lambda b, m: F.abs(b.cast("double") / F.when(m == 0, 1).otherwise(m)))


def imbalance_power(balance: Column, allowed: Column) -> Column:
    """Sum of squares, near violations weighed by NEAR_FACTOR before they are squared."""
    r = relative_imbalance(balance, allowed)
    return _total(F.transform(r, lambda x: F.pow(F.when(x > NEAR, x * NEAR_FACTOR).otherwise(x), F.lit(2))))


def near_violator_power(balance: Column, allowed: Column) -> Column:
    return _total(F.transform(relative_imbalance(balance, allowed), lambda x: F.when(x > NEAR, x * x).otherwise(0.0)))


def violator_power(balance: Column, allowed: Column) -> Column:
    """Sum of squares over the resources whose imbalance is over what is allowed, in either direction."""
    return _total(F.transform(relative_imbalance(balance, allowed), lambda x: F.when(x > 1, x * x).otherwise(0.0)))


def exceeds(balance: Column, allowed: Column) -> Column:
    return F.exists(F.zip_with(balance, allowed, lambda b, m: F.abs(b) > m), lambda x: x)


def ratio_power(total: Column, ratio: Column) -> Column:
    """How far the totals are from the ratios' shares of their sum."""
    scale = F.aggregate(total, F.lit(0).cast("long"), lambda a, x: a + x) / F.aggregate(ratio, F.lit(0).cast("long"), lambda a, x: a + x)
    return _total(F.zip_with(total, ratio, lambda t, r: F.pow(F.abs(t - r * scale) / (r * scale), F.lit(2)))) / RATIO_SIGNIFICANCE


def ratio_power_if_changed(total: Column, old: Column, new: Column, ratio: Column) -> Column:
    return ratio_power(F.zip_with(F.zip_with(total, new, lambda t, n: t + n), old, lambda t, o: t - o), ratio)


def balance_if_moved(balance: Column, weight: Column, from_a: Column) -> Column:
    """Balance (A less B) after a node of that weight changes sides."""
    return F.zip_with(balance, weight, lambda b, w: F.when(from_a, b - 2 * w).otherwise(b + 2 * w))


def max_imbalance(total: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.floor(total * share)).cast("long")


def affinity(weight: Column, allowed: Column) -> Column:
    """The resource of which a weight takes the largest part of the allowance; the first of equals."""
    part = F.zip_with(weight, allowed, lambda w, m: w.cast("double") / m)
    return (F.array_position(part, F.array_max(part)) - 1).cast("int")


def gain_part(own: Column, other: Column, weight: Column) -> Column:
    """What a pin's edge adds to the gain of moving the pin: weight if alone on its side, less weight if the other is empty."""
    return F.when((own == 1) & (other > 0), weight).when((other == 0) & (own > 1), -weight).otherwise(0.0)
