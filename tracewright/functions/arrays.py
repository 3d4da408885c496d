"""Column expressions on arrays: spectra of short traces and their comparison, without leaving the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def fused(before: Column, after: Column, floor: float = 1e-30) -> Column:
    """Geometric mean of two power spectra; of one, that one."""
    both = F.zip_with(before, after, lambda b, a: F.exp(0.5 * F.log(b + floor) + 0.5 * F.log(a + floor)))
    return F.when(before.isNull(), after).when(after.isNull(), before).otherwise(both)


def fused_linear(before: Column, after: Column) -> Column:
    both = F.zip_with(before, after, lambda b, a: (b + a) / 2)
    return F.when(before.isNull(), after).when(after.isNull(), before).otherwise(both)


def cosine(a: Column, b: Column) -> Column:
    """0 where either has hardly any length."""
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)))
    return F.when((norm(a) < 1e-15) | (norm(b) < 1e-15), 0.0).otherwise(total(F.zip_with(a, b, lambda x, y: x * y)) / (norm(a) * norm(b)))


def normalised(psd: Column) -> Column:
    """Over the power of all bins but the first."""
    power = total(F.slice(psd, 2, F.size(psd)))
    return F.when(power > 0, F.transform(psd, lambda v: v / power)).otherwise(psd)


def entropy(psd: Column) -> Column:
    """Shannon entropy of the shares of power, over its greatest value."""
    power = total(psd)
    share = F.transform(psd, lambda v: F.try_divide(v, power))
    return -total(F.transform(share, lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0))) / F.log(F.greatest(F.size(psd), F.lit(2)))


def log_distance(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """Root mean square difference in decibels."""
    d = F.zip_with(a, b, lambda x, y: 10 * F.log10(x + floor) - 10 * F.log10(y + floor))
    return F.sqrt(F.try_divide(total(F.transform(d, lambda v: v * v)), F.size(d)))


def transform_at(x: Column, k: Column, n: int, wave) -> Column:
    return total(F.transform(x, lambda v, i: v * wave(F.lit(2 * math.pi / n) * ((k * i) % n))))


def periodogram(x: Column, n: int) -> Column:
    """|DFT|^2 / n of an array of n values, bins 0 to n/2: for short arrays, where an expression beats a round trip to Python."""
    ks = F.sequence(F.lit(0), F.lit(n // 2))
    return F.transform(ks, lambda k: (F.pow(transform_at(x, k, n, F.cos), F.lit(2)) + F.pow(transform_at(x, k, n, F.sin), F.lit(2))) / n)


def next_power_of_two(n: Column) -> Column:
    """The least power of two that isn't below n."""
    guess = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")) - 1e-12)).cast("long")
    return F.greatest(F.lit(1).cast("long"), guess)
