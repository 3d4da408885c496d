"""Fidelity of a repaired trace to the truth or to the original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges, rolling, runs
from .storage import settled


def errors(truth: str, repaired: str) -> dict[str, Column]:
    """Aggregates: rmse, mae, snr_db, energy_ratio, std_ratio, valid; ratios to a constant truth are null."""
    t, r = F.col(truth), F.col(repaired)
    d = r - t
    return {
        "rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d)), "snr_db": 10 * F.log10(F.try_divide(F.sum(t * t), F.sum(d * d + 1e-12))),
        "energy_ratio": F.try_divide(F.var_pop(r), F.var_pop(t)), "std_ratio": F.try_divide(F.stddev_pop(r), F.stddev_pop(t)), "valid": F.bool_and(r.isNotNull() & ~F.isnan(r)),
    }


def wasserstein(a: DataFrame, b: DataFrame, keys: list[str], value: str = "v", step: int = 4096) -> DataFrame:
    """keys and the 1-D Wasserstein distance between the values of a and b: the area between their distribution functions; null where a side has none."""
    sides = a.select(*keys, F.col(value).alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb")).unionByName(b.select(*keys, F.col(value).alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb")))
    points = sides.groupBy(*keys, "v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))  # one row per value
    order = Window.partitionBy(*keys).orderBy("v")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    rows = points.withColumns({"f": F.try_divide(F.sum("na").over(upto), F.sum("na").over(whole)), "g": F.try_divide(F.sum("nb").over(upto), F.sum("nb").over(whole)), "dx": F.lead("v").over(order) - F.col("v")})
    return rows.groupBy(*keys).agg(F.sum(F.abs(F.col("f") - F.col("g")) * F.coalesce("dx", F.lit(0.0))).alias("wasserstein"))


def autocorrelation(df: DataFrame, column: str, lags: int) -> DataFrame:
    """trace_id, lag, acf for lags 0 to lags-1: products of the demeaned samples, over that of lag 0."""
    x = rolling.per_trace(df, _mean=F.avg(column)).select("trace_id", "idx", (F.col(column) - F.col("_mean")).alias("x"))
    later = x.withColumn("_p", F.collect_list("x").over(Window.partitionBy("trace_id").orderBy("idx").rowsBetween(-(lags - 1), 0)))
    pairs = later.select("trace_id", "x", F.posexplode(F.reverse("_p")).alias("lag", "y"))
    sums = pairs.groupBy("trace_id", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    zero = sums.where("lag = 0").select("trace_id", F.col("c").alias("c0"))
    return sums.join(zero, "trace_id").select("trace_id", F.col("lag").cast("long").alias("lag"), (F.col("c") / F.greatest("c0", F.lit(1e-12))).alias("acf"))


def acf_distance(df: DataFrame, a: str, b: str, lags: int) -> DataFrame:
    """Root mean square difference of two columns' autocorrelations."""
    left, right = autocorrelation(df, a, lags), autocorrelation(df, b, lags).withColumnRenamed("acf", "other")
    d = F.col("acf") - F.col("other")
    return left.join(right, ["trace_id", "lag"]).groupBy("trace_id").agg(F.sqrt(F.avg(d * d)).alias("acf_l2"))


def seams(df: DataFrame, raw: str, repaired: str, width: int) -> DataFrame:
    """Runs of changed samples with the jumps at both ends, over the local deviation of the raw samples around the trace's sample."""
    rows = rolling.rolled(df.withColumn("_changed", F.abs(F.col(raw) - F.col(repaired)) > 1e-9), {"_std": F.stddev_pop(raw)}, width // 2, width - width // 2 - 1)
    found = runs.runs(rows, "_changed")
    at = rows.select("trace_id", F.col("idx").alias("_i"), F.col(repaired).alias("_r"), F.col("_std").alias("_d"))
    for name, place in (("a", F.col("s") - 1), ("b", F.col("s")), ("c", F.col("e")), ("d", F.col("e") + 1)):
        near = at.select(F.col("trace_id").alias(f"_k{name}"), F.col("_i").alias(f"_i{name}"), F.col("_r").alias(f"v_{name}"), F.col("_d").alias(f"d_{name}"))
        found = found.join(near, (F.col("trace_id") == F.col(f"_k{name}")) & (place == F.col(f"_i{name}")), "left").drop(f"_k{name}", f"_i{name}")
    left, right = F.abs(F.col("v_b") - F.col("v_a")) / F.greatest("d_a", F.lit(1e-12)), F.abs(F.col("v_d") - F.col("v_c")) / F.greatest("d_d", F.lit(1e-12))
    return found.select("trace_id", "s", "e", runs.length().alias("length"), left.alias("jump_left"), right.alias("jump_right"))


def file_checks(df: DataFrame, protected: DataFrame, raw: str, repaired: str, missing_raw: Column, missing_repaired: Column, repairs: DataFrame) -> DataFrame:
    """One row per trace: missing samples left outside protected segments, zero holes in repaired ones, changes outside both, and issues."""
    rows = df.select("trace_id", "idx", F.col(raw).alias("a"), F.col(repaired).alias("b"), missing_raw.alias("mr"), missing_repaired.alias("mm"))
    for name, segs in (("_safe", protected), ("_fixed", repairs)):
        inside = ranges.samples_in(rows.select("trace_id", "idx"), segs.select("trace_id", "s", "e")).select("trace_id", "idx").distinct().withColumn(name, F.lit(True))
        rows = rows.join(inside, ["trace_id", "idx"], "left")
    safe, fixed = F.coalesce("_safe", F.lit(False)), F.coalesce("_fixed", F.lit(False))
    out = rows.groupBy("trace_id").agg(
        F.count_if(F.col("mm") & ~safe).alias("missing_residual"), F.count_if(fixed & ~safe & (F.col("b") == 0)).alias("zero_holes"),
        F.count_if(~fixed & ~safe & ~F.col("mr") & ~F.col("a").eqNullSafe(F.col("b"))).alias("untouched_leak"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"),
    )
    return out.withColumn("ok", (F.col("missing_residual") == 0) & (F.col("zero_holes") == 0) & (F.col("untouched_leak") == 0))


def seam_percentiles(df: DataFrame, raw: str, repaired: str, width: int) -> DataFrame:
    """One row per trace: the jumps at the ends of changed runs against the steps between unchanged neighbours.

    Jumps and steps are taken over the deviation of `width` raw samples: those before and after a run, those from a step on (near the trace's
    end its last `width`), the whole trace's where that is 0. Runs at an end of the trace have no seam. Percentiles are shares of steps below.
    """
    rows = df.select("trace_id", "idx", F.col(raw).alias("a"), F.col(repaired).alias("b"))
    rows = rolling.sized(rows.withColumn("changed", F.abs(F.col("a") - F.col("b")) > 1e-9))
    rows = rolling.rolled(rows, {"local": F.stddev_pop("a")}, 0, width - 1)
    whole = rows.groupBy("trace_id").agg(F.stddev_pop("a").alias("whole"), F.max(F.when(F.col("idx") == F.greatest(F.col("n") - width, F.lit(0)), F.col("local"))).alias("last"))
    rows = rows.join(whole, "trace_id").withColumn("local", F.when(F.col("idx") <= F.col("n") - width, F.col("local")).otherwise(F.col("last")))
    rows = settled(rows.withColumn("scale", F.when(F.col("local") > 1e-9, F.col("local")).otherwise(F.col("whole"))), "scales")
    found = runs.runs(rows, "changed").join(rolling.lengths(rows), "trace_id").where("s > 0 AND e < n - 1")
    places = {"_w0": F.greatest(F.col("s") - width, F.lit(0)), "_w1": F.col("e") + 1, "_p0": F.col("s") - 1, "_p1": F.col("s"), "_p2": F.col("e"), "_p3": F.col("e") + 1}
    found = found.withColumns(places)
    for name, column in (("_w0", "scale"), ("_w1", "scale"), ("_p0", "a"), ("_p1", "b"), ("_p2", "b"), ("_p3", "a")):
        found = found.join(rows.select("trace_id", F.col("idx").alias(name), F.col(column).alias(f"{name}_v")), ["trace_id", name])
    jumps = found.select("trace_id", "s", runs.length().alias("length"), F.try_divide(F.abs(F.col("_p1_v") - F.col("_p0_v")), F.col("_w0_v")).alias("left"), F.try_divide(F.abs(F.col("_p2_v") - F.col("_p3_v")), F.col("_w1_v")).alias("right"))
    jumps = jumps.withColumn("most", F.greatest("left", "right"))
    longest = F.struct("length", -F.col("s"))
    seams_of = settled(jumps.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_runs"), F.max_by("length", longest).alias("longest"), F.max_by("most", longest).alias("longest_jump"), rolling.median("most").alias("median_jump"), F.max("most").alias("greatest_jump")), "jumps")
    steps = rolling.shifted(rows.select("trace_id", "idx", "a", "changed", "local"), {"_a": ("a", 1), "_c": ("changed", 1)})
    steps = steps.where("NOT changed AND NOT _c AND local > 1e-9").select("trace_id", (F.abs(F.col("_a") - F.col("a")) / F.col("local")).alias("step"))
    share = lambda c: 100 * F.avg((F.col("step") < F.col(c)).cast("double"))
    p = lambda q: F.percentile("step", F.lit(q))
    return steps.join(seams_of, "trace_id").groupBy(*seams_of.columns).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), share("greatest_jump").alias("greatest_pct"), share("longest_jump").alias("longest_pct"))


def band_percentiles(df: DataFrame, raw: str, repaired: str, around: DataFrame, widths: list[int]) -> DataFrame:
    """trace_id, width, windows, to_healthy, band_pct: how the mean of the repaired window lies among the healthy ones, for several widths.

    A trace's repaired window is centred on its segment (trace_id, s, e); healthy ones are full windows of raw samples that don't meet it. to_healthy is
    the median distance of means from it to them, band_pct the share of pairs of healthy windows that are closer. Pairs are counted by
    running counts over sorted means, and none is made.
    """
    many = around.withColumn("width", F.explode(F.array(*(F.lit(w) for w in widths)))).join(rolling.lengths(df), "trace_id")
    first = F.greatest(F.floor((F.col("s") + F.col("e")) / 2) - F.floor(F.col("width") / 2), F.lit(0))
    many = many.withColumn("w0", first.cast("long")).withColumn("w1", F.col("w0") + F.col("width") - 1).where("w1 < n")
    many = settled(many.select("trace_id", "width", "w0", "w1"), "windows")
    own = ranges.samples_in(df.select("trace_id", "idx", F.col(repaired).alias("v")), many, s="w0", e="w1").groupBy("trace_id", "width", "w0", "w1").agg(F.avg("v").alias("own"))
    cut = df.select("trace_id", "idx", F.col(raw).alias("v")).join(own, "trace_id").withColumn("k", F.floor(F.col("idx") / F.col("width")))
    healthy = cut.groupBy("trace_id", "width", "w0", "w1", "own", "k").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("c"))
    healthy = healthy.where("c = width AND (k * width + width - 1 < w0 OR k * width > w1)").withColumn("m", F.round("m", 9))
    healthy = settled(healthy.select("trace_id", "width", "own", "m"), "healthy")
    near = healthy.groupBy("trace_id", "width").agg(F.count(F.lit(1)).alias("windows"), rolling.median(F.round(F.abs(F.col("m") - F.col("own")), 9)).alias("to_healthy"))
    # a pair is closer than t if the greater mean is below the lesser one's mark, t above it: count means before marks
    rows = healthy.join(near, ["trace_id", "width"]).select("trace_id", "width", "windows", "to_healthy", F.explode(F.array(F.struct(F.col("m").alias("at"), F.lit(1).alias("point")), F.struct(F.round(F.col("m") + F.col("to_healthy"), 9).alias("at"), F.lit(0).alias("point")))).alias("x"))
    before = Window.partitionBy("trace_id", "width").orderBy("x.at", "x.point").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_below", F.when(F.col("x.point") == 0, F.sum("x.point").over(before)))
    n = F.col("windows")
    closer = F.when(F.col("to_healthy") > 0, F.sum("_below") - n * (n + 1) / 2).otherwise(0.0)
    return rows.groupBy("trace_id", "width", "windows", "to_healthy").agg(F.try_divide(100 * closer, n * (n - 1) / 2).alias("band_pct"))


def sizes(raw: DataFrame, repaired: DataFrame) -> DataFrame:
    """Traces of either side with both numbers of samples and whether the same places are there."""
    left, right = raw.select("trace_id", "idx", F.lit(1).alias("_a")), repaired.select("trace_id", "idx", F.lit(1).alias("_b"))
    rows = left.join(right, ["trace_id", "idx"], "full_outer")
    return rows.groupBy("trace_id").agg(F.count("_a").alias("n_raw"), F.count("_b").alias("n_repaired"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched")).withColumn("same", F.col("unmatched") == 0)


def against_known(df: DataFrame, known: DataFrame, raw: str, repaired: str) -> DataFrame:
    """Known segments (trace_id, s, e, expected) with the number of their samples that have changed, and whether it is as expected."""
    inside = ranges.samples_in(df.select("trace_id", "idx", F.col(raw).alias("a"), F.col(repaired).alias("b")), known)
    found = inside.groupBy(*known.columns).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
    rows = known.join(found, known.columns, "left").withColumn("changed", F.coalesce("changed", F.lit(0)))
    return rows.withColumn("as_expected", F.col("changed") == F.col("expected"))
