"""Whether rebuilt segments go on from their references: spectrum, envelope, level, autocorrelation and energy. Long segments are joins and aggregates of samples, others are arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import kernels, spectra
from . import ranges
from .storage import settled

KEY = ["trace_id", "s"]
#: The least spectral likeness, the greatest jumps of envelope and level, the greatest difference of the autocorrelation, and the bounds of the energy.
SPECTRAL, ENVELOPE, LEVEL, AUTOCORRELATION, ENERGY = 0.95, 0.15, 0.05, 0.2, (0.7, 1.3)
#: The band that is compared: from so many Hz up to this share of the sampling rate.
LOW_HZ, HIGH_SHARE = 0.5, 0.45
#: A lag is negative beyond this share of lag 0; what is nearer to 0 is the transform's rounding.
ROUNDING = 1e-12


def parts_of(samples: DataFrame, segments: DataFrame, column: str = "w") -> DataFrame:
    """trace_id, s, side ('before', 'segment', 'after'), pos, x, m: the samples of segments (s, e) and of their references (b_s to b_e, a_s to a_e), with how many there are."""
    out = None
    for side, low, high in (("before", "b_s", "b_e"), ("segment", "s", "e"), ("after", "a_s", "a_e")):
        wide = segments.select("trace_id", "s", F.col(low).cast("long").alias("_w0"), F.col(high).cast("long").alias("_w1")).where("_w0 <= _w1")
        rows = ranges.samples_in(samples.select("trace_id", "idx", F.col(column).cast("double").alias("x")), wide, s="_w0", e="_w1")
        rows = rows.select(*KEY, F.lit(side).alias("side"), (F.col("idx") - F.col("_w0")).alias("pos"), "x", (F.col("_w1") - F.col("_w0") + 1).alias("m"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")) - 1e-12)).cast("long")


def _spectral_sums(parts: DataFrame, sr: float) -> DataFrame:
    """trace_id, s and the products of the power spectra of a segment (x) and its references (b, a), all of the same length; for segments with both."""
    by = [*KEY, "side"]
    size = parts.groupBy(*KEY).agg(_power_of_two(2 * F.max("m")).alias("n"), F.countDistinct("side").alias("_sides")).where("_sides = 3").drop("_sides")
    means = parts.groupBy(*by).agg(F.avg("x").alias("_mean"))
    rows = parts.join(size, KEY).join(means, by)
    out = spectra.dft(spectra.real_rows(rows, by, F.col("pos"), F.col("x") - F.col("_mean"), F.col("n")), by, half=True)
    low, high = F.greatest(F.lit(1), F.floor(LOW_HZ / sr * F.col("n"))), F.least(F.floor(F.col("n") / 2), F.floor(HIGH_SHARE * F.col("n")))
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")
    own = lambda side: F.max(F.when(F.col("side") == side, power))
    bins = out.where((F.col("k") >= low) & (F.col("k") < high)).groupBy(*KEY, "k").agg(own("before").alias("b"), own("segment").alias("x"), own("after").alias("a"))
    dot = lambda p, q: F.sum(F.col(p) * F.col(q))
    return bins.groupBy(*KEY).agg(dot("b", "b").alias("bb"), dot("x", "x").alias("xx"), dot("a", "a").alias("aa"), dot("b", "x").alias("bx"), dot("a", "x").alias("ax"))


def _spectral() -> Column:
    """The lesser cosine of the segment's power spectrum and its references'."""
    cosine = lambda pq, p, q: F.when((F.sqrt(p) < 1e-15) | (F.sqrt(q) < 1e-15), 0.0).otherwise(F.col(pq) / F.sqrt(p) / F.sqrt(q))
    return F.least(cosine("bx", "bb", "xx"), cosine("ax", "aa", "xx"))


def _envelope_sums(parts: DataFrame) -> DataFrame:
    """trace_id, s and the envelopes at the seams, and the references' mean envelopes in the quarters beside them."""
    by = [*KEY, "side"]
    found = spectra.envelope(parts.select(*by, "pos", "x"), by).withColumnRenamed("x", "v").join(parts.groupBy(*by).agg(F.first("m").alias("m")), by)
    at = lambda side, place: F.max(F.when((F.col("side") == side) & (F.col("pos") == place), F.col("v")))
    quarter, last = F.greatest(F.lit(1), F.floor(F.col("m") / 4)), F.col("m") - 1
    mean = lambda side, where: F.avg(F.when((F.col("side") == side) & where, F.col("v")))
    return found.groupBy(*KEY).agg(
        at("before", last).alias("env_b"), at("segment", F.lit(0)).alias("env_x0"), at("segment", last).alias("env_x1"), at("after", F.lit(0)).alias("env_a"),
        mean("before", F.col("pos") >= F.col("m") - quarter).alias("env_bm"), mean("after", F.col("pos") < quarter).alias("env_am"),
    )


def _envelope() -> Column:
    """The greater jump of the envelope at a seam, over the reference's mean envelope in the quarter beside it."""
    left, right = F.abs(F.col("env_b") - F.col("env_x0")) / (F.col("env_bm") + 1e-10), F.abs(F.col("env_x1") - F.col("env_a")) / (F.col("env_am") + 1e-10)
    return F.coalesce(F.greatest(left, right), F.lit(0.0))


def _level_sums(parts: DataFrame) -> DataFrame:
    """trace_id, s and the means of the quarters at the seams, the references' deviations, and mean squares."""
    quarter = F.greatest(F.lit(1), F.floor(F.col("m") / 4))
    first, last = F.col("pos") < quarter, F.col("pos") >= F.col("m") - quarter
    of = lambda side, value, where=F.lit(True): F.when((F.col("side") == side) & where, value)
    x = F.col("x")
    return parts.groupBy(*KEY).agg(
        F.avg(of("before", x, last)).alias("b"), F.avg(of("segment", x, first)).alias("x0"), F.avg(of("segment", x, last)).alias("x1"), F.avg(of("after", x, first)).alias("a"), F.stddev_pop(of("before", x)).alias("bs"), F.stddev_pop(of("after", x)).alias("as_"),
        F.avg(of("before", x * x)).alias("be"), F.avg(of("segment", x * x)).alias("xe"), F.avg(of("after", x * x)).alias("ae"), F.count(of("segment", x)).cast("double").alias("n"),
    )


def _level_and_energy() -> tuple[Column, Column]:
    """The greater jump of the mean between quarters at a seam, over the reference's deviation; and the segment's mean square over its references'."""
    left, right = F.abs(F.col("b") - F.col("x0")) / (F.col("bs") + 1e-10), F.abs(F.col("a") - F.col("x1")) / (F.col("as_") + 1e-10)
    reference = F.when(F.col("be").isNull(), F.col("ae")).when(F.col("ae").isNull(), F.col("be")).otherwise((F.col("be") + F.col("ae")) / 2)
    energy = (F.col("xe") * F.col("n") + 1e-30) / (reference * F.col("n") + 1e-30)
    return F.coalesce(F.greatest(left, right), F.lit(0.0)), F.coalesce(energy, F.lit(1.0))


def _first_lags(parts: DataFrame) -> DataFrame:
    """trace_id, s and the first negative lags of the reference before and of the segment; values as they are, with their mean."""
    by = [*KEY, "side"]
    rows = parts.where("side <> 'after'")
    power = spectra.dft(spectra.real_rows(rows, by, F.col("pos"), F.col("x"), _power_of_two(2 * F.col("m"))), by)
    power = power.select(*by, F.col("k").alias("pos"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"), F.lit(0.0).alias("im"), "n")
    lags = spectra.dft(power, by, sign=1, half=True).join(rows.groupBy(*by).agg(F.first("m").alias("m"), F.sum(F.col("x") * F.col("x")).alias("own")), by).where(F.col("k") < F.col("m"))
    first = lags.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("re") / F.col("n") < -ROUNDING * F.col("own"), F.col("k"))), F.first("m")).alias("lag"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("lag"))).cast("double")
    return first.groupBy(*KEY).agg(of("before").alias("lag_b"), of("segment").alias("lag_x"))


def _autocorrelation() -> Column:
    """How far apart the first negative lags are, over the reference's."""
    return F.coalesce(F.abs(F.col("lag_b") - F.col("lag_x")) / F.nullif(F.col("lag_b"), F.lit(0.0)), F.lit(0.0))


#: What the measures are made of: see _spectral_sums, _envelope_sums, _first_lags and _level_sums.
SUMS = ("bb", "xx", "aa", "bx", "ax", "env_b", "env_x0", "env_x1", "env_a", "env_bm", "env_am", "lag_b", "lag_x", "b", "x0", "x1", "a", "bs", "as_", "be", "xe", "ae", "n")


def _sums_of(before: pa.Array | None, segment: pa.Array | None, after: pa.Array | None, sr: float) -> dict[str, float]:
    """The sums of one segment from the values of its parts; a part with a null has no transform."""
    out, power, mean = {"n": 0.0}, {}, lambda v: float(v.mean()) if len(v) else None
    sides = {k: v for k, v in (("b", before), ("x", segment), ("a", after)) if v is not None and len(v)}
    size = kernels.power_of_two(2 * max((len(v) for v in sides.values()), default=1))
    low, high = max(1, int(LOW_HZ / sr * size)), min(size // 2, int(HIGH_SHARE * size))
    for k, values in sides.items():
        x, m, quarter = values.to_numpy(zero_copy_only=False), len(values), max(1, len(values) // 4)
        there = values.is_valid().to_numpy(zero_copy_only=False)
        ends, known = {"0": mean(x[:quarter][there[:quarter]]), "1": mean(x[-quarter:][there[-quarter:]])}, x[there]
        out |= {"x0": ends["0"], "x1": ends["1"], "n": float(len(known))} if k == "x" else {k: ends["1" if k == "b" else "0"], {"b": "bs", "a": "as_"}[k]: float(known.std()) if len(known) else None}
        out[f"{k}e"] = mean(known * known)
        if k != "a":
            out[f"lag_{k}"] = float(m)
        if not there.all():
            continue
        power[k] = (np.abs(np.fft.rfft(x - x.mean(), size)) ** 2 / size)[low:high]
        envelope = np.abs(kernels.analytic(x))
        out |= {"env_x0": envelope[0], "env_x1": envelope[-1]} if k == "x" else {"env_b": envelope[-1], "env_bm": envelope[-quarter:].mean()} if k == "b" else {"env_a": envelope[0], "env_am": envelope[:quarter].mean()}
        if k != "a":
            own = kernels.power_of_two(2 * m)
            negative = np.flatnonzero(np.fft.irfft(np.abs(np.fft.rfft(x, own)) ** 2, own)[:m] < -ROUNDING * (x @ x))
            out[f"lag_{k}"] = float(negative[0]) if len(negative) else float(m)
    if len(sides) == 3:
        out |= {p + q: float(power[p] @ power[q]) for p, q in ("bb", "xx", "aa", "bx", "ax") if p in power and q in power}
    return out


def sums_in_tasks(samples: DataFrame, segments: DataFrame, sr: float, column: str = "w") -> DataFrame:
    """trace_id, s and all sums of segments whose parts are arrays: no sample is joined, grouped or transformed as a row."""
    sides = {"_before": ("b_s", "b_e"), "_segment": ("s", "e"), "_after": ("a_s", "a_e")}
    held = ranges.arrays_in(samples, segments, {k: (F.col(low), F.col(high)) for k, (low, high) in sides.items()}, F.col(column).cast("double"), ("s",))
    schema = StructType([*held.schema.fields[: len(KEY)], *(StructField(c, DoubleType()) for c in SUMS)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sums_of(*(x.values for x in row), sr) for row in zip(*batch.columns[len(KEY) :])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(KEY)], *(pa.array([f.get(c) for f in found], pa.float64()) for c in SUMS)], names=[*KEY, *SUMS])

    return held.mapInArrow(each, schema)


def sums_by_rows(samples: DataFrame, segments: DataFrame, sr: float, column: str = "w") -> DataFrame:
    """The same as joins and aggregates of samples, for parts that are too long for one task."""
    parts = settled(parts_of(samples, segments, column), "verify")
    rows = segments.select(*KEY)
    for sums in (_spectral_sums(parts, sr), _envelope_sums(parts), _first_lags(parts), _level_sums(parts)):
        rows = rows.join(sums, KEY, "left")
    return rows.select(*KEY, *SUMS)


def verified(samples: DataFrame, segments: DataFrame, sr: float, column: str = "w", whole: int = spectra.WHOLE) -> DataFrame:
    """Segments with the five measures, `passed`, and `issues`: the names of those that are out of bounds.

    A reference that isn't there is empty (its end before its start). Without both, the spectral likeness is 0; without either the others tell nothing against the segment.
    whole: up to how many places a transform is made by one task.
    """
    segments = settled(segments, "segments")
    longest = F.greatest(*(F.col(high) - F.col(low) + 1 for low, high in (("b_s", "b_e"), ("s", "e"), ("a_s", "a_e"))))
    sums, long = sums_in_tasks(samples, segments.where(2 * longest <= whole), sr, column), segments.where(2 * longest > whole)
    if not long.isEmpty():
        sums = sums.unionByName(sums_by_rows(samples, long, sr, column))
    level, energy = _level_and_energy()
    measures = {"spectral": _spectral(), "envelope": _envelope(), "level": level, "autocorrelation": _autocorrelation(), "energy": energy}
    rows = segments.join(sums.select(*KEY, *(c.alias(name) for name, c in measures.items())), KEY, "left").withColumn("spectral", F.coalesce("spectral", F.lit(0.0)))
    low, high = ENERGY
    broken = {
        "spectral": F.col("spectral") < SPECTRAL, "envelope": F.col("envelope") > ENVELOPE, "level": F.col("level") > LEVEL, "autocorrelation": F.col("autocorrelation") > AUTOCORRELATION,
        "energy": ~F.col("energy").between(low, high),
    }
    issues = F.concat_ws(",", *(F.when(where, name) for name, where in broken.items()))
    return rows.withColumn("issues", issues).withColumn("passed", F.col("issues") == "")
