"""Per-sample masks: what is missing, saturated, frozen, spiking, stepping or bursting, and classic outlier tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SATURATION, Detection
from . import rolling, runs
from .storage import settled


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def missing_counts(x: Column) -> Column:
    """Raw counts of -1 or less, 0, and what isn't finite."""
    return ~finite(x) | (x <= -1) | (x == 0)


def missing_sentinel(x: Column) -> Column:
    return ~finite(x) | (x == -1)


def saturated(x: Column) -> Column:
    return finite(x) & ((x >= SATURATION) | (x <= -SATURATION))


def without_dc(df: DataFrame, column: str = "v", out: str = "x") -> DataFrame:
    """The median of what is finite and above -1 is taken off; missing values of -1 or less and non-finite ones count as 0 first. Adds dc."""
    good = F.when(finite(F.col(column)) & (F.col(column) > -1), F.col(column))
    df = rolling.per_trace(df, dc=F.coalesce(rolling.median(good), F.lit(0.0)))
    held = F.when(finite(F.col(column)) & (F.col(column) > -1), F.col(column)).otherwise(F.lit(0.0))
    return df.withColumn(out, held - F.col("dc"))


def freeze_runs(df: DataFrame, config: Detection, column: str = "v") -> DataFrame:
    """Runs of equal samples of at least the threshold, which is higher for traces where such runs are common."""
    least, common = config.samples(config.freeze_s), config.samples(config.freeze_common_s)
    long = runs.state_runs(df, column).where((runs.length() >= max(2, least)) & finite(F.col("state"))).drop("state")
    counts = long.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_count"))
    least_here = F.when(F.col("_count") > config.freeze_common_runs, max(least, common)).otherwise(least)
    return long.join(counts, "trace_id").where(runs.length() >= least_here).drop("_count")


def spike(df: DataFrame, config: Detection, column: str = "x", out: str = "spike") -> DataFrame:
    """Residual from the rolling median against its own rolling scale, with a floor from the whole trace."""
    w, names = config.spike_window, df.columns
    df = rolling.sized(rolling.mad_scale(df, column, "_global"))
    df = rolling.rolling_median(df, column, w, "_base")
    df = df.withColumn("_residual", F.abs(F.col(column) - F.col("_base")))
    df = rolling.rolling_median(df, "_residual", w, "_scale")
    threshold = config.spike_k * F.greatest(1.4826 * F.col("_scale"), F.greatest(F.col("_global"), F.lit(0.5)) * 0.5)
    return df.withColumn(out, F.col("_residual") > threshold).select(*names, out)


def step(df: DataFrame, config: Detection, column: str = "x", out: str = "step") -> DataFrame:
    """Both samples of a difference that is far from the median difference."""
    df = rolling.shifted(df, {"_previous": (column, -1), "_next": (column, 1)})
    df = df.withColumn("_up", F.col("_next") - F.col(column)).withColumn("_down", F.col(column) - F.col("_previous"))
    df = rolling.mad_scale(df, "_up", "_mad")
    limit = config.step_k * F.greatest(F.col("_mad"), F.lit(0.5))
    far = lambda d: F.coalesce(F.abs(F.col(d) - F.col("_center")) > limit, F.lit(False))
    return df.withColumn(out, far("_up") | far("_down")).drop("_previous", "_next", "_up", "_down", "_center", "_mad")


def energy(df: DataFrame, config: Detection, column: str = "x", out: str = "energy") -> DataFrame:
    """Short RMS far above the trace's median level, or above the local long RMS; widened by one sample."""
    short, long, names = config.samples(config.rms_short_s), config.samples(config.rms_long_s), df.columns
    df = rolling.sized(df)
    df = rolling.rolling_rms(rolling.rolling_rms(df, column, short, "_short"), column, long, "_long")
    df = rolling.per_trace(settled(df, "rms"), _median=rolling.median("_short"))
    floor = F.col("_median") * 0.5 + 1e-9
    above = F.when(F.col("_median") < config.low_rms, config.rms_ratio * 2.0 * config.low_gain).otherwise(config.rms_ratio * 2.0)
    hit = (F.col("_short") / floor > above) | (F.col("_short") / F.greatest(F.col("_long"), floor * 2.0) > config.rms_ratio)
    return rolling.dilated(df.withColumn("_hit", hit), "_hit", out).select(*names, out)


def all_masks(df: DataFrame, config: Detection, column: str = "v") -> DataFrame:
    """Adds dc, x, missing, sat, freeze, spike, step, morph and energy to raw samples."""
    df = settled(rolling.per_trace(without_dc(df, column), n=F.max("idx") + 1), "raw")
    df = df.withColumns({"missing": missing_counts(F.col(column)), "sat": saturated(F.col(column))})
    frozen = freeze_runs(df, config, column).select("trace_id", F.explode(F.sequence("s", "e")).alias("idx"), F.lit(True).alias("freeze"))
    df = df.join(frozen, ["trace_id", "idx"], "left").withColumn("freeze", F.coalesce("freeze", F.lit(False)))
    df = settled(spike(df, config), "spike")
    df = energy(settled(step(df, config), "step"), config).drop("n")
    return settled(df, "masks").withColumn("morph", F.col("sat") | F.col("missing") | F.col("freeze") | F.col("spike") | F.col("step"))


def mad_outliers(df: DataFrame, column: str, k: float, out: str) -> DataFrame:
    """Further from the median than k scales; the scale is the deviation, or 1, where the median deviation is 0."""
    df = rolling.per_trace(rolling.mad_scale(df, column, "_mad"), _std=F.stddev_pop(column))
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return df.withColumn(out, F.coalesce(F.abs(F.col(column) - F.col("_center")) > k * scale, F.lit(False))).drop("_center", "_mad", "_std")


def zscore_outliers(df: DataFrame, column: str, k: float, out: str) -> DataFrame:
    df = rolling.per_trace(df, _mean=F.avg(column), _std=F.stddev_pop(column))
    scale = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return df.withColumn(out, F.coalesce(F.abs(F.col(column) - F.col("_mean")) > k * scale, F.lit(False))).drop("_mean", "_std")


def threshold_outliers(x: Column, limit: float | str) -> Column:
    """Beyond a number in size, or on one side for '>v' and '<v'."""
    if isinstance(limit, str) and limit.strip()[:1] in "<>":
        value = float(limit.strip()[1:])
        return x > value if limit.strip()[0] == ">" else x < value
    return F.abs(x) > abs(float(limit))


def moving_average_outliers(df: DataFrame, column: str, width: int, limit: float, out: str) -> DataFrame:
    """Further than `limit` from the moving average with zeros outside the trace."""
    return rolling.boxcar(df, column, width, "_mean").withColumn(out, F.abs(F.col(column) - F.col("_mean")) > limit).drop("_mean")


def segment_outliers(df: DataFrame, column: str = "v", z: float = 4.0, least: int = 10) -> DataFrame:
    """Marks samples of segments (trace_id, seg_id) by a robust z-score over those that are there; with no median deviation, by 15 or 5 % of the median. Missing samples are never marked, nor any of a segment with fewer than `least` others."""
    by, there = ["trace_id", "seg_id"], F.when(~missing_counts(F.col(column)), F.col(column))
    df = df.withColumn("_x", there)
    df = df.join(df.groupBy(*by).agg(rolling.median("_x").alias("_med"), F.count("_x").alias("_n")), by).withColumn("_dev", F.abs(F.col("_x") - F.col("_med")))
    df = df.join(df.groupBy(*by).agg(rolling.median("_dev").alias("_mad")), by)
    score = F.when(F.col("_mad") >= 1e-6, 0.6745 * F.col("_dev") / F.col("_mad") > z).otherwise(F.col("_dev") > F.greatest(F.lit(15.0), 0.05 * F.col("_med")))
    return df.withColumn("outlier", F.coalesce(score & (F.col("_n") >= least), F.lit(False))).drop("_med", "_dev", "_mad", "_x", "_n")
