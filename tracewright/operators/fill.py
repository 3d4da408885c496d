"""Filling of marked samples from their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranges, rolling, runs
from .storage import settled


def neighbours(df: DataFrame, bad: str, column: str) -> DataFrame:
    """Runs of bad samples with the good samples around them: trace_id, s, e, then left and right place and value (null outside the trace).

    The samples beside a run are looked up by equality, so no window reaches over long runs.
    """
    found = runs.runs(df, bad)
    side = df.select("trace_id", F.col("idx").alias("_i"), F.col(column).alias("_v"))
    left = side.select("trace_id", (F.col("_i") + 1).alias("s"), F.col("_v").alias("left_v"))
    right = side.select("trace_id", (F.col("_i") - 1).alias("e"), F.col("_v").alias("right_v"))
    return found.join(left, ["trace_id", "s"], "left").join(right, ["trace_id", "e"], "left").select("trace_id", "s", "e", "left_v", "right_v")


def clamped_fill(df: DataFrame, bad: str, column: str, out: str) -> DataFrame:
    """A line between the good neighbours of each run; at the ends of the trace, the one neighbour's value."""
    around = neighbours(df, bad, column)
    at = (F.col("idx") - F.col("s") + 1) / (F.col("e") - F.col("s") + 2)
    line = F.col("left_v") + (F.col("right_v") - F.col("left_v")) * at
    filled = ranges.samples_in(df.select("trace_id", "idx"), around).select("trace_id", "idx", F.coalesce(line, F.col("left_v"), F.col("right_v")).alias("_filled"), F.lit(True).alias("_bad"))
    rows = df.join(filled, ["trace_id", "idx"], "left")
    return rows.withColumn(out, F.when(F.col("_bad"), F.col("_filled")).otherwise(F.col(column))).drop("_filled", "_bad")


def segment_fill(samples: DataFrame, bad: str, column: str, out: str) -> DataFrame:
    """Samples of segments (trace_id, seg_id, idx) filled from good ones of the same segment.

    Between two good samples lies their line; before the first and after the last, the line through the two nearest
    good ones goes on. With fewer than two, the trace's median of good samples.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("trace_id", "seg_id").orderBy("idx")
    good = F.when(~F.col(bad), F.struct(F.col("idx").alias("i"), F.col(column).alias("v")))
    rows = rolling.per_trace(samples, _median=rolling.median(F.when(~F.col(bad), F.col(column))))
    past, future = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_good", good)
    rows = rows.withColumns({"_a": F.last("_good", True).over(past), "_b": F.first("_good", True).over(future)})
    whole = Window.partitionBy("trace_id", "seg_id")
    # the first two and the last two good samples of the segment
    ends = samples.where(~F.col(bad)).groupBy("trace_id", "seg_id").agg(F.min_by(F.struct(F.col("idx").alias("i"), F.col(column).alias("v")), "idx").alias("_f1"), F.max_by(F.struct(F.col("idx").alias("i"), F.col(column).alias("v")), "idx").alias("_l1"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(ends, ["trace_id", "seg_id"], "left")
    second = F.min(F.when(~F.col(bad) & (F.col("idx") > F.col("_f1.i")), F.struct(F.col("idx").alias("i"), F.col(column).alias("v")))).over(whole)
    before_last = F.max(F.when(~F.col(bad) & (F.col("idx") < F.col("_l1.i")), F.struct(F.col("idx").alias("i"), F.col(column).alias("v")))).over(whole)
    rows = rows.withColumns({"_f2": second, "_l2": before_last})
    through = lambda a, b: F.col(f"{a}.v") + (F.col(f"{b}.v") - F.col(f"{a}.v")) * (F.col("idx") - F.col(f"{a}.i")) / (F.col(f"{b}.i") - F.col(f"{a}.i"))
    value = F.when(F.coalesce(F.col("_n"), F.lit(0)) < 2, F.col("_median")).when(F.col("_a").isNull(), through("_f1", "_f2")).when(F.col("_b").isNull(), through("_l2", "_l1")).otherwise(through("_a", "_b"))
    return rows.withColumn(out, F.when(F.col(bad), value).otherwise(F.col(column))).drop("_median", "_good", "_a", "_b", "_f1", "_l1", "_n", "_f2", "_l2")


def median_fill(df: DataFrame, bad: str, column: str, out: str) -> DataFrame:
    df = rolling.per_trace(df, _median=rolling.median(F.when(~F.col(bad), F.col(column))))
    return df.withColumn(out, F.when(F.col(bad), F.col("_median")).otherwise(F.col(column))).drop("_median")


def replaced(df: DataFrame, bad: Column, by: Column, column: str, out: str) -> DataFrame:
    return df.withColumn(out, F.when(bad, by).otherwise(F.col(column)))


def spike_fill(df: DataFrame, column: str, out: str, width: int = 7, k: float = 8.0, flag: str | None = None) -> DataFrame:
    """Samples far from their rolling median are put on the line between their neighbours, where they may have been already; flag names a column that marks them."""
    names = df.columns
    df = rolling.sized(rolling.mad_scale(df, column, "_global"))
    df = rolling.rolling_median(df, column, width, "_base").withColumn("_residual", F.abs(F.col(column) - F.col("_base")))
    df = rolling.rolling_median(df, "_residual", width, "_scale")
    hit = F.col("_residual") > k * F.greatest(1.4826 * F.col("_scale") + 1e-9, 0.5 * F.col("_global"))
    marked = settled(df.select(*names, hit.alias("_spike")), "spikes")
    filled = clamped_fill(marked, "_spike", column, out)
    return filled.withColumnRenamed("_spike", flag) if flag else filled.drop("_spike")


def background(df: DataFrame, segments: DataFrame, bad: str, column: str, sr: float, context_s: float = 30.0) -> DataFrame:
    """Segments (trace_id, s, e) with `level` and `spread`: the median of the good samples within context_s around each, of three times that if there are fewer than 30, of the
    trace if still fewer than 8; and 1.4826 times the median deviation from it, 0.5 at least."""
    key, reach = ["trace_id", "s", "e"], int(context_s * sr)
    good = df.where(~F.col(bad)).select("trace_id", "idx", F.col(column).alias("_v"))
    wide = segments.select(*key, (F.col("s") - 3 * reach).alias("_w0"), (F.col("e") + 3 * reach).alias("_w1"))
    near = ranges.samples_in(good, wide, s="_w0", e="_w1").where((F.col("idx") < F.col("s")) | (F.col("idx") > F.col("e")))
    near = settled(near.select(*key, "_v", ((F.col("idx") >= F.col("s") - reach) & (F.col("idx") <= F.col("e") + reach)).alias("_close")), "near")
    close = F.when(F.col("_close"), F.col("_v"))
    found = near.groupBy(*key).agg(F.count(close).alias("_n1"), rolling.median(close).alias("_m1"), F.count("_v").alias("_n2"), rolling.median("_v").alias("_m2"))
    whole = rolling.mad_scale(good.withColumnRenamed("_v", "v"), "v", "_c3", "_m3").groupBy("trace_id").agg(F.first("_m3").alias("_m3"), F.first("_c3").alias("_c3"))
    rows = segments.select(*key).join(found, key, "left").join(whole, "trace_id", "left")
    rows = settled(rows.select(*key, "_c3", F.when(F.col("_n1") >= 30, 1).when(F.col("_n2") >= 8, 2).otherwise(3).alias("_set"), F.when(F.col("_n1") >= 30, F.col("_m1")).when(F.col("_n2") >= 8, F.col("_m2")).otherwise(F.col("_m3")).alias("level")), "levels")
    spread = near.join(rows, key).where("_set = 2 OR (_set = 1 AND _close)").groupBy(*key).agg((1.4826 * rolling.median(F.abs(F.col("_v") - F.col("level")))).alias("_c"))
    return rows.join(spread, key, "left").select(*key, "level", F.greatest(F.coalesce("_c", "_c3", F.lit(0.0)), F.lit(0.5)).alias("spread"))


def zscore_fill(df: DataFrame, segments: DataFrame, bad: str, column: str, out: str, sr: float, context_s: float = 30.0, z: float = 4.0) -> DataFrame:
    """In segments that don't overlap, samples that are bad or beyond z spreads from the background's level are put on the line through the segment's other samples, or at that level if fewer than two are left."""
    inside = ranges.samples_in(df.select("trace_id", "idx", F.col(column).alias("_v"), F.col(bad).alias("_bad")), background(df, segments, bad, column, sr, context_s))
    hit = F.col("_bad") | (F.abs(F.col("_v") - F.col("level")) > z * F.col("spread"))
    rows = settled(inside.select("trace_id", F.col("s").alias("seg_id"), "idx", "_v", "level", F.coalesce(hit, F.lit(True)).alias("_hit")), "inside")
    known = rows.groupBy("trace_id", "seg_id").agg(F.count_if(~F.col("_hit")).alias("_known"))
    lined = segment_fill(rows, "_hit", "_v", "_line").join(known, ["trace_id", "seg_id"])
    new = lined.where("_hit").select("trace_id", "idx", F.when(F.col("_known") < 2, F.col("level")).otherwise(F.col("_line")).alias("_new"))
    rest = df.drop(out) if out != column else df
    return rest.join(new, ["trace_id", "idx"], "left").withColumn(out, F.coalesce("_new", F.col(column))).drop("_new")


def protected_fill(df: DataFrame, zones: DataFrame, bad: str, column: str, out: str, width: int = 7, k: float = 8.0) -> DataFrame:
    """In zones (trace_id, s, e) that are otherwise left alone, single spikes and missing samples are put on the line through the zone's other samples.

    A spike is further from the rolling median than k scales, where a scale is that of the residuals around it, and half the trace's at least. Missing samples count as 0 there. Windows end with the zone.
    """
    raw = df.select("trace_id", "idx", F.when(F.col(bad), 0.0).otherwise(F.col(column)).alias("_raw"), F.col(bad).alias("_bad"))
    whole = rolling.mad_scale(raw, "_raw", "_glob").groupBy("trace_id").agg(F.first("_glob").alias("_glob"))
    inside = ranges.samples_in(raw, zones.select("trace_id", "s", "e")).join(whole, "trace_id")
    own = settled(inside.select(F.struct("trace_id", "s").alias("trace_id"), (F.col("idx") - F.col("s")).alias("idx"), "_raw", "_bad", "_glob"), "zones")
    own = rolling.rolling_median(rolling.sized(own), "_raw", width, "_base").withColumn("_residual", F.abs(F.col("_raw") - F.col("_base")))
    own = rolling.rolling_median(own, "_residual", width, "_scale")
    hit = F.col("_bad") | (F.col("_residual") > k * F.greatest(1.4826 * F.col("_scale") + 1e-9, 0.5 * F.col("_glob")))
    rows = settled(own.select(F.col("trace_id.trace_id").alias("trace_id"), F.col("trace_id.s").alias("seg_id"), "idx", "_raw", hit.alias("_hit")), "zones-marked")
    known = rows.groupBy("trace_id", "seg_id").agg(F.count_if(~F.col("_hit")).alias("_known"), F.max(F.when(~F.col("_hit"), F.col("_raw"))).alias("_only"))
    lined = segment_fill(rows, "_hit", "_raw", "_line").join(known, ["trace_id", "seg_id"]).where("_hit")
    new = lined.select("trace_id", (F.col("seg_id") + F.col("idx")).alias("idx"), F.when(F.col("_known") < 2, F.coalesce("_only", F.lit(0.0))).otherwise(F.col("_line")).alias("_new"))
    return df.join(new, ["trace_id", "idx"], "left").withColumn(out, F.coalesce("_new", F.col(column))).drop("_new")


def floored(df: DataFrame, column: str, out: str, kept: str) -> DataFrame:
    """What isn't above 0 is put on a line, then rounded half to even, at least 1; kept samples stay."""
    bad = ~F.col(kept) & (F.col(column).isNull() | F.isnan(column) | (F.col(column) <= 0))
    df = clamped_fill(df.withColumn("_low", bad), "_low", column, "_line")
    return df.withColumn(out, F.when(F.col(kept), F.col(column)).otherwise(F.greatest(F.lit(1.0), F.rint("_line")))).drop("_low", "_line")
