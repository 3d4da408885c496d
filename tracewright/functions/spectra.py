"""Discrete Fourier transforms: short ones by numpy in the task that has them, long ones as relational plans of two rounds of shorter ones.

Rows are (keys..., pos, re, im, n): values of a transform of n places, pos from 0. Up to WHOLE places a transform is one row with an array, and n log n steps. Beyond, with n = a * b, place j = j1 b + j2 and frequency k = k1 + a k2, the transforms over j1 are made for each j2, turned by j2 k1 / n, and then
transforms over j2 are made for each k1. Each of these is one row with an array of about the square root of n values, so that one long transform spreads over the cluster; its
steps are n (a + b). a is the greatest divisor of n up to its square root; of a prime n it is 1, and the steps are n squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..operators.storage import settled
from .arrays import total

_TURN = 2 * math.pi
#: Places of a transform that one row holds, and places that are transformed at once.
WHOLE, AT_ONCE = 1 << 16, 1 << 20


def divisor(n: Column) -> Column:
    """The greatest divisor of n up to its square root."""
    upto = F.greatest(F.lit(1), F.floor(F.sqrt(n.cast("double"))).cast("int"))
    return F.array_max(F.filter(F.sequence(F.lit(1), upto), lambda d: n % d == 0))


def _sums(items: Column, place: str, frequency: Column, size: Column, sign: int) -> Column:
    """The transform's value at a frequency, of an array of (place, re, im)."""
    angle = lambda x: (x[place] * frequency % size) * (sign * _TURN) / size
    real = total(F.transform(items, lambda x: x["re"] * F.cos(angle(x)) - x["im"] * F.sin(angle(x))))
    imaginary = total(F.transform(items, lambda x: x["re"] * F.sin(angle(x)) + x["im"] * F.cos(angle(x))))
    return F.struct(real.alias("re"), imaginary.alias("im"))


def _transformed(part: pa.RecordBatch, n: int, sign: int, half: bool) -> tuple[pa.Array, pa.Array]:
    """Real and imaginary parts, as lists, of transforms of n places each."""
    xs = part.column(part.num_columns - 1)
    items, row = xs.flatten(), np.repeat(np.arange(len(xs)), np.diff(xs.offsets.to_numpy()))
    pos, re, im = (items.field(c) for c in ("pos", "re", "im"))
    values = np.zeros(len(xs) * n, complex)
    np.add.at(values, row * n + pos.to_numpy(zero_copy_only=False) % n, re.to_numpy(zero_copy_only=False) + 1j * im.to_numpy(zero_copy_only=False))
    values = values.reshape(len(xs), n)
    out = np.fft.fft(values) if sign < 0 else np.fft.ifft(values, norm="forward")
    out = out[:, : n // 2 + 1] if half else out
    gone = np.zeros(len(xs), bool)  # a null makes all of its transform null
    gone[row[re.is_null().to_numpy(zero_copy_only=False) | im.is_null().to_numpy(zero_copy_only=False)]] = True
    offsets, mask = np.arange(len(xs) + 1, dtype=np.int32) * out.shape[1], np.repeat(gone, out.shape[1])
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel(), mask=mask)) for x in (out.real, out.imag))


def _in_tasks(first: DataFrame, keys: Sequence[str], sign: int, half: bool) -> DataFrame:
    """keys, n, k, re, im of rows (keys..., n, xs) that hold a transform each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                mine, step = np.flatnonzero(sizes == n), max(1, AT_ONCE // int(n))
                for at in range(0, len(mine), step):
                    part = batch.take(pa.array(mine[at : at + step]))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_transformed(part, int(n), sign, half)], names=[*part.schema.names[:-1], "re", "im"])

    held = first.select(*keys, "n", "xs")
    schema = StructType([*held.schema.fields[:-1], *(StructField(c, ArrayType(DoubleType())) for c in ("re", "im"))])
    out = held.mapInArrow(each, schema).select(*keys, "n", F.posexplode(F.arrays_zip("re", "im")).alias("k", "y"))
    return out.select(*keys, "n", F.col("k").cast("long").alias("k"), F.col("y.re").alias("re"), F.col("y.im").alias("im"))


def _in_two_rounds(first: DataFrame, keys: Sequence[str], sign: int, half: bool) -> DataFrame:
    """keys, n, k, re, im of rows (keys..., n, _a, _b, j2, xs) that hold the places of a transform with the same j2."""
    n, a, b = F.col("n"), F.col("_a"), F.col("_b")
    first = first.withColumn("xs", F.array_sort("xs"))
    inner = F.transform(F.sequence(F.lit(0), a - 1), lambda k: F.struct(k.cast("long").alias("k1"), _sums(F.col("xs"), "pos", k.cast("long"), a, sign).alias("y")))
    inner = first.select(*keys, "n", "_a", "_b", "j2", F.explode(inner).alias("e")).select(*keys, "n", "_a", "_b", "j2", "e.k1", "e.y")
    angle = (F.col("j2") * F.col("k1") % n) * (sign * _TURN) / n
    re, im = F.col("y.re") * F.cos(angle) - F.col("y.im") * F.sin(angle), F.col("y.re") * F.sin(angle) + F.col("y.im") * F.cos(angle)
    second = inner.select(*keys, "n", "_a", "_b", "k1", F.struct("j2", re.alias("re"), im.alias("im")).alias("x"))
    second = second.groupBy(*keys, "n", "_a", "_b", "k1").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    ks = F.sequence(F.lit(0).cast("long"), b - 1)
    if half:
        ks = F.filter(ks, lambda k: F.col("k1") + a * k <= F.floor(n / 2))
    outer = F.transform(ks, lambda k: F.struct((F.col("k1") + a * k).cast("long").alias("k"), _sums(F.col("xs"), "j2", k, b, sign).alias("y")))
    return second.select(*keys, "n", F.explode(outer).alias("e")).select(*keys, "n", "e.k", F.col("e.y.re").alias("re"), F.col("e.y.im").alias("im"))


def dft(rows: DataFrame, keys: Sequence[str], sign: int = -1, half: bool = False, whole: int = WHOLE) -> DataFrame:
    """keys, n, k, re, im: the sum of values times exp(sign 2 pi i pos k / n); of half, only the frequencies up to n / 2. Places that have no row count as 0.

    whole: up to how many places a transform is one row.
    """
    n, b = F.col("n"), F.col("_b")
    rows = rows.withColumn("_a", F.when(n <= whole, n).otherwise(divisor(n))).withColumn("_b", (n / F.col("_a")).cast("long"))
    first = rows.select(*keys, "n", "_a", "_b", (F.col("pos") % b).alias("j2"), F.struct(F.floor(F.col("pos") / b).cast("long").alias("pos"), "re", "im").alias("x"))
    first = settled(first.groupBy(*keys, "n", "_a", "_b", "j2").agg(F.collect_list("x").alias("xs")), "transforms")
    short, long = _in_tasks(first.where("_b = 1"), keys, sign, half), first.where("_b > 1")
    return short if long.isEmpty() else short.unionByName(_in_two_rounds(long, keys, sign, half))


def real_rows(df: DataFrame, keys: Sequence[str], pos: Column, value: Column, n: Column) -> DataFrame:
    return df.select(*keys, pos.cast("long").alias("pos"), value.cast("double").alias("re"), F.lit(0.0).alias("im"), n.cast("long").alias("n"))


def _centred(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with n, and x without its mean."""
    by = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("_mean"))
    return df.join(by, list(keys)).withColumn("x", F.col("x") - F.col("_mean")).drop("_mean")


def amplitude_spectrum(df: DataFrame, keys: Sequence[str], sr: float) -> DataFrame:
    """keys, k, frequency, amplitude of (keys, pos, x) without missing places: the mean taken off, under a symmetric Hann window, over the window's sum; 8 places at least."""
    held = _centred(df, keys).where("n >= 8")
    window = 0.5 - 0.5 * F.cos(_TURN * F.col("pos") / (F.col("n") - 1))
    sums = held.groupBy(*keys).agg(F.sum(window).alias("_w"))
    out = dft(real_rows(held, keys, F.col("pos"), F.col("x") * window, F.col("n")), keys, half=True).join(sums, list(keys))
    amplitude = F.when(F.col("k") == 0, 1.0).otherwise(2.0) * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("_w")
    return out.select(*keys, "k", (F.col("k") * sr / F.col("n")).alias("frequency"), amplitude.alias("amplitude"))


def window_length(n: Column, least: int = 256, most: int = 16_384) -> Column:
    """The greatest power of two up to n, between two bounds; n itself if it is less than the lower one."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) + 1e-12)).cast("long")
    return F.least(n, F.greatest(F.lit(least), F.least(F.lit(most), power)))


def welch(df: DataFrame, keys: Sequence[str], sr: float, least: int = 256, most: int = 16_384) -> DataFrame:
    """keys, k, frequency, power of (keys, pos, x): periodograms of half-overlapping windows, each without its mean and under a periodic Hann window, averaged. Density, one-sided; 8 places at least."""
    held = _centred(df, keys).where("n >= 8").withColumn("_l", window_length(F.col("n"), least, most)).withColumn("_step", F.col("_l") - F.floor(F.col("_l") / 2))
    last = F.floor((F.col("n") - F.col("_l")) / F.col("_step"))
    low, high = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("_l") + 1) / F.col("_step"))), F.least(last, F.floor(F.col("pos") / F.col("_step")))
    windows = held.where(low <= high).withColumn("_w", F.explode(F.sequence(low, high))).withColumn("_p", F.col("pos") - F.col("_w") * F.col("_step"))
    by = [*keys, "_w"]
    means = windows.groupBy(*by).agg(F.avg("x").alias("_mean"))
    hann = 0.5 - 0.5 * F.cos(_TURN * F.col("_p") / F.col("_l"))
    windows = windows.join(means, by)
    scale = windows.groupBy(*by).agg(F.sum(hann * hann).alias("_ww"))
    out = dft(real_rows(windows, by, F.col("_p"), (F.col("x") - F.col("_mean")) * hann, F.col("_l")), by, half=True).join(scale, by)
    return _density(out, F.col("_ww"), sr).groupBy(*keys, "k", "frequency").agg(F.avg("power").alias("power"))


def _density(out: DataFrame, scale: Column, sr: float) -> DataFrame:
    """One-sided power density: all but the first frequency, and the last of an even n, stand for two."""
    once = (F.col("k") == 0) | ((F.col("n") % 2 == 0) & (F.col("k") == F.col("n") / 2))
    power = F.when(once, 1.0).otherwise(2.0) * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (sr * scale)
    return out.withColumns({"power": power, "frequency": F.col("k") * sr / F.col("n")})


def periodogram(df: DataFrame, keys: Sequence[str], sr: float) -> DataFrame:
    """keys, k, frequency, power of (keys, pos, x) as one window without its mean."""
    held = _centred(df, keys)
    return _density(dft(real_rows(held, keys, F.col("pos"), F.col("x"), F.col("n")), keys, half=True), F.col("n"), sr).select(*keys, "k", "frequency", "power")


def band_power(spectrum: DataFrame, keys: Sequence[str], low: float, high: float, power: str = "power") -> DataFrame:
    """keys, power within [low, high): the densities' sum times the step of frequency."""
    step = F.min(F.when(F.col("k") == 1, F.col("frequency")))
    inside = F.sum(F.when((F.col("frequency") >= low) & (F.col("frequency") < high), F.col(power)).otherwise(0.0))
    return spectrum.groupBy(*keys).agg((inside * step).alias("power"))


def band_rms(one: DataFrame, other: DataFrame, keys: Sequence[str], low: float = 0.01, high: float = 1.0) -> DataFrame:
    """keys, rms: the root mean square difference of two spectra within [low, high)."""
    both = one.where((F.col("frequency") >= low) & (F.col("frequency") < high)).join(other.select(*keys, "k", F.col("power").alias("_other")), [*keys, "k"])
    return both.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("power") - F.col("_other"), F.lit(2)))).alias("rms"))


def band_profile(f: Column, low: float, high: float, transition: float, inside: float = 1.0, outside: float = 0.0) -> Column:
    """`inside` from low to high, `outside` beyond a transition on both sides, and a smooth step between; without a transition a sharp edge."""
    within = (f >= low) & (f <= high)
    if transition <= 1e-12 or high <= low:
        return F.when(within, inside).otherwise(outside)
    start = max(0.0, low - transition)
    smooth = lambda t: t * t * (3 - 2 * t)
    rising = F.when((f >= start) & (f < low), outside + (inside - outside) * smooth((f - start) / transition))
    falling = F.when((f > high) & (f <= high + transition), inside - (inside - outside) * smooth((f - high) / transition))
    return F.when(within, inside).otherwise(F.coalesce(rising, falling, F.lit(outside)))


def band_component(df: DataFrame, keys: Sequence[str], sr: float, low: float, high: float, transition: float) -> DataFrame:
    """keys, pos, x of (keys, pos, x): what the band profile lets pass. The transform has twice as many places, rounded up to a power of two, so that the ends don't meet."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    double = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(2), 2 * F.col("_n")).cast("double")) - 1e-12))
    spectrum = dft(real_rows(df.join(sizes, list(keys)), keys, F.col("pos"), F.col("x"), double), keys)
    f = F.least(F.col("k"), F.col("n") - F.col("k")) * sr / F.col("n")
    mask = band_profile(f, low, high, transition)
    passed = spectrum.select(*keys, F.col("k").alias("pos"), (F.col("re") * mask).alias("re"), (F.col("im") * mask).alias("im"), "n").where("re <> 0 OR im <> 0")
    back = dft(passed, keys, sign=1).select(*keys, F.col("k").alias("pos"), (F.col("re") / F.col("n")).alias("_x"))
    return df.select(*keys, "pos").join(back, [*keys, "pos"], "left").select(*keys, "pos", F.coalesce("_x", F.lit(0.0)).alias("x"))


def envelope(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pos, x: the size of the analytic signal of (keys, pos, x), which has its positive frequencies twice and no negative ones."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spectrum = dft(real_rows(df.join(sizes, list(keys)), keys, F.col("pos"), F.col("x"), F.col("_n")), keys, half=True)
    once = (F.col("k") == 0) | ((F.col("n") % 2 == 0) & (F.col("k") == F.col("n") / 2))
    weight = F.when(once, 1.0).otherwise(2.0)
    analytic = dft(spectrum.select(*keys, F.col("k").alias("pos"), (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im"), "n"), keys, sign=1)
    return analytic.select(*keys, F.col("k").alias("pos"), (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("x"))


#: Ranges of value that a set is ordered in.
VALUE_RANGES = 256


def set_distance(one: DataFrame, other: DataFrame, keys: Sequence[str], value: str = "x", parts: int = VALUE_RANGES) -> DataFrame:
    """keys, distance: the area between the distribution functions of two sets of values, which may be of different size. Keys that only one has are left out.

    Values are ordered within ranges of value, and running totals and the first value of the next range come from a table of ranges: no key is one task.
    """
    keys = list(keys)
    sizes = one.groupBy(*keys).agg(F.count(value).alias("_n1")).join(other.groupBy(*keys).agg(F.count(value).alias("_n2")), keys)
    both = one.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_one")).unionByName(other.select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_one"))).where("_v IS NOT NULL")
    ends = both.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    share = (F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    counted = both.join(ends, keys).withColumn("_range", F.coalesce(F.least(F.lit(parts - 1), F.floor(share * parts)), F.lit(0)).cast("int"))
    counted = counted.groupBy(*keys, "_range", "_v").agg(F.sum("_one").alias("_c1"), F.sum(1 - F.col("_one")).alias("_c2"))
    along = Window.partitionBy(*keys).orderBy("_range")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ranges_ = counted.groupBy(*keys, "_range").agg(F.sum("_c1").alias("_s1"), F.sum("_c2").alias("_s2"), F.min("_v").alias("_min"))
    ranges_ = ranges_.select(*keys, "_range", F.coalesce(F.sum("_s1").over(before), F.lit(0)).alias("_b1"), F.coalesce(F.sum("_s2").over(before), F.lit(0)).alias("_b2"), F.lead("_min").over(along).alias("_next"))
    within = Window.partitionBy(*keys, "_range").orderBy("_v")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.join(ranges_, [*keys, "_range"]).join(sizes, keys)
    gap = F.coalesce(F.lead("_v").over(within), F.col("_next"), F.col("_v")) - F.col("_v")
    apart = F.abs((F.col("_b1") + F.sum("_c1").over(upto)) / F.col("_n1") - (F.col("_b2") + F.sum("_c2").over(upto)) / F.col("_n2"))
    return rows.select(*keys, (gap * apart).alias("_area")).groupBy(*keys).agg(F.sum("_area").alias("distance"))
