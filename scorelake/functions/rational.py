"""Exact fractions over integer columns; never floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Euclid's steps for any two 64-bit numbers.
STEPS = 93


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative integers (``gcd(a, 0)`` is ``a``); null if either is null."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["a"])
    return F.when(a.isNotNull() & b.isNotNull(), found)


def same_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether a/b = c/d, by cross multiplication."""
    return a * d == c * b


def reduced(num: Column, den: Column) -> Column:
    """``STRUCT<num, den>`` in lowest terms."""
    g = gcd(num, den)
    return F.when(den > 0, F.struct((num / g).cast("long").alias("num"), (den / g).cast("long").alias("den")))
