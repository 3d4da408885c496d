"""Spikes that stand alone: detection that leaves real, longer movements in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fill, ranges, rolling, runs
from .storage import settled

#: Verdicts of spans that are to be repaired.
REPAIRED = ("accepted", "short_saturation_plateau", "extreme_isolated_peak")


def _invalid(v: Column) -> Column:
    return v.isNull() | F.isnan(v) | (v == -1)


def judged(df: DataFrame, column: str, sr: float, base_s: float = 0.75, scale_s: float = 4.0, k: float = 8.0, global_k: float = 4.0, widest: int = 2, plateau: int = 4, returned: float = 0.35, strong_k: float = 16.0, strong_global_k: float = 6.0, strong_ratio: float = 1.25) -> DataFrame:
    """trace_id, s, e, peak, verdict of runs far from the rolling median, or at a clipping level.

    A trace clips if its greatest value occurs twice or more and stands well above the 99.5th percentile of the others.
    Accepted: at most `widest` samples, inside the trace, with neighbours that have come back. Of the other runs, short
    plateaus at the clipping level are repaired whole, and of the rest only their extreme peaks, up to `plateau` samples each;
    runs without either say why they stay. Missing samples (null, NaN, -1) lie on a line and are in no run.
    """
    base, wide = int(base_s * sr) | 1, int(scale_s * sr) | 1
    given = settled(df.select("trace_id", "idx", F.col(column).alias("raw"), _invalid(F.col(column)).alias("gone")), "given")
    rows = rolling.sized(fill.clamped_fill(given, "gone", "raw", "v")).select("trace_id", "idx", "n", "v", "gone")
    rows = rolling.rolling_median(rows, "v", base, "_base", "edge").withColumn("res", F.abs(F.col("v") - F.col("_base")))
    rows = settled(rolling.rolling_median(rows, "res", wide, "_local", "edge"), "residuals")
    good = F.when(~F.col("gone"), F.col("v"))
    tops = rows.groupBy("trace_id").agg(F.max(good).alias("high"), rolling.median("v").alias("mid"))
    rows = rows.join(tops, "trace_id")
    levels = rows.groupBy("trace_id", "high").agg(
        F.greatest(1.4826 * rolling.median(F.abs(F.col("v") - F.col("mid"))), F.lit(2.0**-52)).alias("glob"),
        F.count_if(good == F.col("high")).alias("at_high"), F.percentile(F.when(good < F.col("high"), good), F.lit(0.995)).alias("below"),
    )
    clips = (F.col("at_high") >= 2) & (F.col("high") - F.coalesce("below", "high") >= F.greatest(F.lit(4.0), 8 * F.col("glob")))
    rows = rows.drop("high", "mid").join(levels.select("trace_id", "glob", F.when(clips, F.col("high")).alias("clip")), "trace_id")
    rows = rows.withColumn("scale", F.greatest(1.4826 * F.col("_local"), 0.05 * F.col("glob")))
    rows = rolling.shifted(rows, {"res_p": ("res", -1), "res_n": ("res", 1), "scale_p": ("scale", -1), "scale_n": ("scale", 1)})
    sat = ~F.col("gone") & F.coalesce(F.col("v") == F.col("clip"), F.lit(False))
    far = ~F.col("gone") & (F.col("res") > F.greatest(k * F.col("scale"), global_k * F.col("glob")))
    peak = F.col("res_p").isNotNull() & F.col("res_n").isNotNull() & (F.col("res") >= strong_k * F.col("scale")) & (F.col("res") >= strong_global_k * F.col("glob"))
    peak &= F.col("res") >= strong_ratio * F.greatest("res_p", "res_n")
    rows = rows.select("trace_id", "idx", "n", "res", "res_p", "res_n", "scale_p", "scale_n", sat.alias("sat"), (far | sat).alias("run"), F.coalesce(sat | peak, F.lit(False)).alias("strong"))
    rows = settled(rows, "scales")
    found = ranges.samples_in(rows.where("run"), runs.runs(rows, "run")).groupBy("trace_id", "s", "e", "n").agg(
        F.max("res").alias("peak"), F.greatest(F.min_by("res_p", "idx"), F.max_by("res_n", "idx")).alias("near"), F.greatest(F.min_by("scale_p", "idx"), F.max_by("scale_n", "idx")).alias("beside"),
        F.bool_and("sat").alias("flat"), F.bool_or("strong").alias("strong"),
    )
    length, edge = runs.length(), (F.col("s") == 0) | (F.col("e") == F.col("n") - 1)
    active = F.col("near") > F.greatest(returned * F.col("peak"), 2 * F.col("beside"))
    reason = F.when(length > widest, "run_too_long").when(edge, "edge_run").when(active, "neighbours_not_returned")
    verdict = F.when(reason.isNull(), "accepted").when(F.col("flat") & (length <= plateau), "short_saturation_plateau").when(F.col("strong"), "peaks").otherwise(reason)
    found = settled(found.select("trace_id", "s", "e", "peak", verdict.alias("verdict")), "verdicts")
    active_rows = ranges.samples_in(rows.where("run AND strong").select("trace_id", "idx", "res"), found.where("verdict = 'peaks'").select("trace_id", "s", "e"))
    peaks = runs.runs(active_rows.select("trace_id", "idx", F.lit(True).alias("strong")), "strong").where(length <= plateau)
    peaks = ranges.samples_in(active_rows.select("trace_id", "idx", "res"), peaks).groupBy("trace_id", "s", "e").agg(F.max("res").alias("peak")).withColumn("verdict", F.lit("extreme_isolated_peak"))
    return found.where("verdict <> 'peaks'").unionByName(peaks)


def curve(x: Column, s: Column, e: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """The monotone cubic through the samples at s-2, s-1, e+1 and e+2, between the middle two."""
    h = e - s + 2
    before, across, after = b - a, (c - b) / h, d - c
    slope = lambda p, q, wp, wq: F.when(p * q <= 0, F.lit(0.0)).otherwise((wp + wq) / (wp / p + wq / q))
    # a neighbouring interval's slope weighs less the longer the other interval is
    left, right = slope(before, across, 2 * h + 1, h + 2), slope(across, after, h + 2, 2 * h + 1)
    t = (x - s + 1) / h
    return b * (1 + 2 * t) * (1 - t) * (1 - t) + left * h * t * (1 - t) * (1 - t) + c * t * t * (3 - 2 * t) + right * h * t * t * (t - 1)


def replaced(df: DataFrame, column: str, out: str, sr: float, **options) -> DataFrame:
    """df with spikes that are to be repaired on a curve through two samples of each side.

    Of fewer than four good ones, the line between the nearest of each side, or one side's nearest value; with fewer than two,
    the samples stay. The samples around are looked at as given.
    """
    found = settled(judged(df, column, sr, **options).where(F.col("verdict").isin(*REPAIRED)).select("trace_id", "s", "e"), "spikes")
    wide = found.select("trace_id", "s", "e", (F.col("s") - 2).alias("_w0"), (F.col("e") + 2).alias("_w1"))
    near = ranges.samples_in(df.where(~_invalid(F.col(column))).select("trace_id", "idx", F.col(column).alias("_v")), wide, s="_w0", e="_w1")
    at = lambda place: F.max(F.when(F.col("idx") == place, F.col("_v")))
    s, e = F.col("s"), F.col("e")
    near = near.where((F.col("idx") < s) | (F.col("idx") > e)).groupBy("trace_id", "s", "e").agg(at(s - 2).alias("_a"), at(s - 1).alias("_b"), at(e + 1).alias("_c"), at(e + 2).alias("_d"), F.count(F.lit(1)).alias("_k"))
    inside = ranges.samples_in(df.select("trace_id", "idx"), near.where("_k >= 2"))
    x, a, b, c, d = (F.col(n) for n in ("idx", "_a", "_b", "_c", "_d"))
    left, right = F.coalesce(b, a), F.coalesce(c, d)
    left_at, right_at = F.when(b.isNotNull(), s - 1).otherwise(s - 2), F.when(c.isNotNull(), e + 1).otherwise(e + 2)
    line = F.coalesce(left + (right - left) * (x - left_at) / (right_at - left_at), left, right)
    value = F.when(F.col("_k") == 4, curve(x, s, e, a, b, c, d)).otherwise(line)
    return df.join(inside.select("trace_id", "idx", value.alias("_new")), ["trace_id", "idx"], "left").withColumn(out, F.coalesce("_new", column)).drop("_new")
