"""Test signals and planted anomalies whose random numbers depend on a seed and a counter alone: no state, the same however rows are dealt."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectra
from . import ranges

#: Seconds of dropouts; numbers and widths of spikes; the window and the amplitude of spikes.
DROPOUT_S = {"small": 300, "medium": 900, "large": 3600}
SPIKES = {"small": (5, 1, 1), "medium": (10, 3, 5), "large": (20, 5, 10)}
SPIKE_WINDOW_S, AMPLITUDE, JITTER = 1500, 500, 0.15
FAMILIES = ("multitone", "chirp", "coda", "transient")


def seed_of(*parts: Column | str) -> Column:
    """CRC-32 of the parts with bars between."""
    return F.crc32(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary"))


def draw(seed: Column, counter: Column, what: str) -> Column:
    """A whole number from 0 to 2^52 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), counter.cast("string"), F.lit(what)).cast("binary")), 1, 13), 16, 10).cast("long")


def uniform(seed: Column, counter: Column, what: str) -> Column:
    return (draw(seed, counter, what) + 0.5) / float(1 << 52)


def normal(seed: Column, counter: Column, what: str = "normal") -> Column:
    """Standard normal, by two uniform numbers."""
    return F.sqrt(-2 * F.log(uniform(seed, counter, what + "1"))) * F.cos(2 * math.pi * uniform(seed, counter, what + "2"))


def planted(traces: DataFrame, kind: str, level: str, sr: float, scale: float = 1.0, share: float = 0.9) -> DataFrame:
    """trace_id, s, e, sign of a dropout, or of spikes in cells of equal size at places that jitter, around `share` of each trace (trace_id, n, seed). scale: shortens all times."""
    n, center = F.col("n"), F.floor(F.col("n") * share)
    if kind == "dropout":
        size = int(DROPOUT_S[level] * scale * sr)
        s = center - size // 2
        return traces.select("trace_id", F.greatest(F.lit(1), s).cast("long").alias("s"), F.least(n - 2, s + size - 1).cast("long").alias("e"), F.lit(0).alias("sign")).where("s <= e")
    many, narrow, wide = SPIKES[level]
    size = int(SPIKE_WINDOW_S * scale * sr)
    first = F.greatest(F.lit(1), center - size // 2)
    last = F.least(n - 2, center - size // 2 + size - 1)
    rows = traces.select("trace_id", "seed", first.alias("w0"), last.alias("w1"), F.floor((last - first + 1) / many).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("k"))
    width = narrow + draw(F.col("seed"), F.col("k"), "width") % (wide - narrow + 1)
    jitter = F.floor(F.col("cell") * JITTER)
    at = F.col("w0") + F.floor((F.col("k") + 0.5) * F.col("cell")) + draw(F.col("seed"), F.col("k"), "place") % (2 * jitter + 1) - jitter - F.floor(width / 2)
    rows = rows.withColumn("width", width).withColumn("s", F.greatest(F.col("w0"), F.least(at, F.col("w1") - F.col("width"))).cast("long"))
    sign = F.when(draw(F.col("seed"), F.col("k"), "sign") % 2 == 0, -1).otherwise(1)
    return rows.select("trace_id", "s", (F.col("s") + F.col("width") - 1).cast("long").alias("e"), sign.alias("sign"))


def injected(samples: DataFrame, places: DataFrame) -> DataFrame:
    """Samples with w: 0 in dropouts (sign 0), AMPLITUDE up or down in spikes; where spikes meet, the last one's sign counts."""
    hit = ranges.samples_in(samples.select("trace_id", "idx"), places).groupBy("trace_id", "idx").agg(F.max_by("sign", "s").alias("_sign"))
    rows = samples.join(hit, ["trace_id", "idx"], "left")
    return rows.withColumn("w", F.when(F.col("_sign") == 0, 0.0).otherwise(F.col("v") + AMPLITUDE * F.coalesce("_sign", F.lit(0)))).drop("_sign")


def signals(cases: DataFrame, n: int, sr: float) -> DataFrame:
    """trace_id, idx, v of cases (trace_id, family, seed): tones in noise, a modulated chirp, decaying band-passed noise, and that with a burst.

    Noise is band-passed by the profile of frequencies, without a delay.
    """
    spaced = cases.select("trace_id", "family", "seed", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias("idx"))
    t, noise, turn = F.col("idx") / sr, normal(F.col("seed"), F.col("idx")), 2 * math.pi
    tones = 0.5 * F.sin(turn * 0.1 * t) + 0.3 * F.sin(turn * 0.5 * t) + 0.2 * F.sin(turn * 1.0 * t) + 0.1 * noise
    low, high, end = 0.05, 1.0, max((n - 1) / sr, 1e-9)
    phase = turn * (low * t + 0.5 * (high - low) / end * t * t)
    chirp = 0.6 * F.sin(phase) * (1 + 0.3 * F.sin(turn * 0.02 * t)) + 0.05 * noise
    plain = spaced.where(F.col("family").isin("multitone", "chirp")).select("trace_id", "idx", F.when(F.col("family") == "multitone", tones).otherwise(chirp).alias("v"))
    noisy = spaced.where(F.col("family").isin("coda", "transient"))
    tail = spectra.band_component(noisy.select("trace_id", F.col("idx").alias("pos"), noise.alias("x")), ["trace_id"], sr, 0.02, 0.8, 0.02)
    burst, first = int(30 * sr), int(n * 0.3)
    event = noisy.where("family = 'transient'").where(F.col("idx") < burst).select("trace_id", F.col("idx").alias("pos"), normal(F.col("seed"), F.col("idx"), "burst").alias("x"))
    event = spectra.band_component(event, ["trace_id"], sr, 0.05, 1.2, 0.02).select("trace_id", (F.col("pos") + first).alias("idx"), (5.0 * F.col("x")).alias("_burst"))
    tail = noisy.join(tail.withColumnRenamed("pos", "idx"), ["trace_id", "idx"]).join(event, ["trace_id", "idx"], "left")
    decaying = F.col("x") * F.exp(-t / 300.0) * 3.0
    value = F.when(F.col("family") == "coda", decaying).otherwise(0.5 * decaying + F.coalesce("_burst", F.lit(0.0)))
    return plain.unionByName(tail.select("trace_id", "idx", value.alias("v")))
