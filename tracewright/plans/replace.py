"""Repair of segments of traces, one kernel call per segment; references and contexts are gathered by range joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import ranges, rolling
from ..operators.storage import settled

CONTEXT = 132

REPORT = "trace_id string, s long, e long, method string, mean double, std double, seed long"


def _fill(method: str, before, after, left, right, n: int, sr: float, gap: int, seed: int) -> np.ndarray:
    if method == "core":
        return kernels.reconstructed(before, after, left, right, n, sr, gap, seed)
    near = lambda x, k, last: x[-k:] if last else x[:k]
    a, b = near(left, 50, True), near(right, 50, False)
    if not len(a) or not len(b):
        return np.full(n, (a if len(a) else b).mean() if len(a) or len(b) else np.nan)
    x = np.concatenate([np.arange(-len(a), 0), n + np.arange(len(b))]).astype(float)
    y, at = np.concatenate([a, b]), np.arange(n, dtype=float)
    if method == "pchip":
        return kernels.pchip(x, y, at)
    if method == "spline":
        return kernels.cubic_spline(x, y, at) if len(x) > 2 else np.interp(at, x, y)
    if method == "ar":
        return kernels.autoregressive(a, b, n) if min(len(a), len(b)) > 16 else np.interp(at, x, y)
    if method == "ssa":
        whole = np.concatenate([left, np.zeros(n), right])
        hole = np.zeros(len(whole), bool)
        hole[len(left) : len(left) + n] = True
        return kernels.singular_spectrum(whole, hole, max(4, min(200, max(32, n // 4), len(whole) // 2)))[hole]
    if method == "lowpass":
        whole = np.concatenate([left, np.linspace(left[-1], right[0], n), right])
        return kernels.low_pass(whole)[len(left) : len(left) + n]
    return np.interp(at, x, y)


def core(s: int, e: int, before, after, left, right, sr: float, gap: int, seed: int, method: str = "core") -> np.ndarray:
    """The values of a segment from its references and surroundings, as arrays that may be empty; a reference of fewer than 4 is none."""
    before, after = (x if len(x) >= 4 else None for x in (before, after))
    return _fill(method, before, after, left, right, e - s + 1, sr, gap, seed + s)


def segment_contexts(samples: DataFrame, segments: DataFrame, sr: float, gap: int, bad: str = "bad", column: str = "v", reach=None) -> DataFrame:
    """Segments with arrays of the good samples before and after: references beyond the safety gap, and what touches the segment."""
    wide = ranges.reference_windows(segments, rolling.lengths(samples), ranges.auto_reference(sr) if reach is None else reach, gap)
    s, e = F.col("s"), F.col("e")
    parts = {"before": (F.col("b_s"), F.col("b_e")), "after": (F.col("a_s"), F.col("a_e")), "left": (F.greatest(F.lit(0), s - CONTEXT), s - 1), "right": (e + 1, e + CONTEXT)}
    good = F.when(~F.col(bad), F.coalesce(F.col(column).cast("double"), F.lit(float("nan"))))
    held = ranges.arrays_in(samples, wide, parts, good)
    return segments.join(held.select("trace_id", "s", "e", *(F.filter(c, lambda x: x.isNotNull()).alias(c) for c in parts)), ["trace_id", "s", "e"], "left")


def rebuilt(contexts: DataFrame, sr: float, gap: int, seed: int = 0, quantize: bool = False) -> DataFrame:
    """From segments (trace_id, s, e, method) with their references and surroundings as arrays: a report per segment with `values`."""

    def each(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                array = lambda x: np.asarray(x if x is not None else [], float)
                own = seed + int(r.s)
                x = core(int(r.s), int(r.e), *(array(x) for x in (r.before, r.after, r.left, r.right)), sr, gap, seed, r.method)
                x = np.rint(x) if quantize else x
                rows.append({"trace_id": r.trace_id, "s": r.s, "e": r.e, "method": r.method, "values": x, "mean": float(x.mean()), "std": float(x.std()), "seed": own})
            columns = ["trace_id", "s", "e", "method", "mean", "std", "seed", "values"]
            yield pd.DataFrame(rows, columns=columns)

    return contexts.select("trace_id", "s", "e", "method", "before", "after", "left", "right").mapInPandas(each, f"{REPORT}, values array<double>")


def placed(done: DataFrame) -> DataFrame:
    """trace_id, s, idx, w of segments with `values`."""
    return done.select("trace_id", "s", F.posexplode("values").alias("k", "w")).select("trace_id", "s", (F.col("s") + F.col("k")).alias("idx"), "w")


def replaced(samples: DataFrame, segments: DataFrame, sr: float, gap_s: float = 1.0, seed: int = 0, quantize: bool = False, bad: str = "bad", column: str = "v") -> tuple[DataFrame, DataFrame]:
    """Repairs segments (trace_id, s, e, method): rows (trace_id, s, idx, w) of new values, and a report per segment.

    Segments are repaired from the samples as given, side by side. Nothing outside them is written.
    """
    gap = round(gap_s * sr)
    done = settled(rebuilt(segment_contexts(samples, segments, sr, gap, bad, column), sr, gap, seed, quantize), "rebuilt")
    return placed(done), done.drop("values")


def written_back(samples: DataFrame, values: DataFrame, column: str = "v", out: str = "w") -> DataFrame:
    """Samples with the new values in their places."""
    new = values.select("trace_id", "idx", F.col("w").alias("_w"))
    return samples.join(new, ["trace_id", "idx"], "left").withColumn(out, F.coalesce(F.when(~F.isnan("_w"), F.col("_w")), F.col(column))).drop("_w")
