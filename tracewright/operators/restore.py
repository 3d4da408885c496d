"""Around a rebuilt segment: how far it should reach, what its references may hold, whether to keep it, and its edges.

Every operator looks at the samples as given, so that segments are independent. Samples are (trace_id, idx, ...), segments (trace_id, s, e, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges, rolling, runs
from .storage import settled

KEY = ["trace_id", "s", "e"]


def _levels(points: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Per group the number of values, their median and 1.4826 times the median deviation from it."""
    middle = points.groupBy(*keys).agg(rolling.median(column).alias("m"), F.count(column).alias("k"))
    return points.join(middle, keys).groupBy(*keys, "m", "k").agg((1.4826 * rolling.median(F.abs(F.col(column) - F.col("m")))).alias("sc"))


def _baselines(good: DataFrame, segments: DataFrame, n: DataFrame, skip: int, far: int, least: int, floor: float) -> DataFrame:
    """Segments with `base`: of the far windows of both sides, the steadier one's median if they differ much, else the mean of both medians."""
    sides = [("l", F.col("s") - far - skip, F.col("s") - skip - 1), ("r", F.col("e") + 1 + skip, F.col("e") + skip + far)]
    out = segments
    for side, low, high in sides:
        wide = segments.select(*KEY, F.greatest(low, F.lit(0)).cast("long").alias("_w0"), high.cast("long").alias("_w1")).where("_w1 >= _w0")
        found = _levels(ranges.samples_in(good, wide, s="_w0", e="_w1"), KEY, "v").where(F.col("k") >= least)
        out = out.join(found.select(*KEY, F.col("m").alias(f"_m{side}"), F.col("sc").alias(f"_c{side}")), KEY, "left")
    steady, other = F.when(F.col("_cl") <= F.col("_cr"), F.col("_ml")).otherwise(F.col("_mr")), F.abs(F.col("_ml") - F.col("_mr"))
    both = F.when(other > 2 * F.greatest(F.least("_cl", "_cr"), F.lit(floor)), steady).otherwise((F.col("_ml") + F.col("_mr")) / 2)
    return out.withColumn("base", F.coalesce(both, "_ml", "_mr")).drop("_ml", "_cl", "_mr", "_cr")


def _grown(good: DataFrame, segments: DataFrame, n: DataFrame, walls: DataFrame, side: str, look: int, steps: int, longest: int, pad: int, k: float, floor: float) -> DataFrame:
    """Segments with one end moved outwards, window by window, up to the first that is at the base level, nearly empty, or meets a wall."""
    s, e, i = F.col("s"), F.col("e"), F.col("i")
    low, high = (s - i * look, s - 1 - (i - 1) * look) if side == "left" else (e + 1 + (i - 1) * look, e + i * look)
    tried = segments.where("base IS NOT NULL").where(runs.length() < longest).join(n, "trace_id").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    tried = tried.withColumns({"a": F.greatest(low, F.lit(0)).cast("long"), "b": F.least(high, F.col("n") - 1).cast("long")}).where((F.col("a") <= F.col("b")) & (runs.length() + (i - 1) * look < longest))
    tried = settled(tried.select(*KEY, "base", "i", "a", "b"), "windows")
    free = _clear(tried, walls)
    levels = _levels(ranges.samples_in(good, free, s="a", e="b"), [*KEY, "base", "i", "a", "b"], "v")
    off = levels.where((F.col("k") >= 4) & (F.abs(F.col("m") - F.col("base")) > k * F.greatest("sc", F.lit(floor))))
    # the windows from the segment on, without a hole: the i-th that is off is window i
    order = Window.partitionBy(*KEY).orderBy("i")
    reach = off.withColumn("_r", F.row_number().over(order)).where("_r = i").groupBy(*KEY).agg(F.min("a").alias("_a"), F.max("b").alias("_b"))
    out = segments.join(reach, KEY, "left").join(n, "trace_id")
    new = F.coalesce("_a", "s") if side == "left" else F.coalesce("_b", "e")
    out = out.withColumns({"_s0": s, "_e0": e, "s": new if side == "left" else s, "e": new if side == "right" else e})
    room = F.least(F.lit(pad), longest - runs.length(), F.col("s") if side == "left" else F.col("n") - 1 - F.col("e"))
    extra = out.where("_a IS NOT NULL").withColumn("_room", room).where("_room > 0")
    extra = extra.withColumns({"a": F.col("s") - F.col("_room") if side == "left" else F.col("e") + 1, "b": F.col("s") - 1 if side == "left" else F.col("e") + F.col("_room")})
    padded = _clear(settled(extra.select("trace_id", "_s0", "_e0", "_room", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "pads"), walls)
    out = out.join(padded.select("trace_id", "_s0", "_e0", "_room"), ["trace_id", "_s0", "_e0"], "left")
    more = F.coalesce("_room", F.lit(0))
    return out.withColumns({"s": (F.col("s") - more if side == "left" else F.col("s")).cast("long"), "e": (F.col("e") + more if side == "right" else F.col("e")).cast("long")}).select(*segments.columns)


def _clear(windows: DataFrame, walls: DataFrame) -> DataFrame:
    """Windows a to b that meet no wall."""
    return ranges.overlapping(windows, walls.select("trace_id", F.col("s").alias("a"), F.col("e").alias("b")), "left_anti", s="a", e="b")


def refined(segments: DataFrame, samples: DataFrame, column: str, bad: str, walls: DataFrame, sr: float, look_s: float = 8.0, far_s: float = 90.0, skip_s: float = 35.0, expand_s: float = 240.0, longest_s: float = 1800.0, pad_s: float = 15.0, k: float = 2.5, floor: float = 0.5) -> DataFrame:
    """Segments widened to where the trace is back at its level, right end first; those that then share a sample are joined, the first one's kind stays.

    The level is taken from beyond `skip_s`, so that a decaying tail isn't taken for it. A window of `look_s` belongs to the segment if its
    median is off the level by more than k deviations; after the last one `pad_s` more do. Walls (trace_id, s, e) are never entered.
    Segments without a level, or of `longest_s` and more, stay.
    """
    look = max(1, int(look_s * sr))
    far, skip = max(look, int(far_s * sr)), max(look, int(skip_s * sr))
    n = settled(rolling.lengths(samples), "lengths")
    good = samples.where(~F.col(bad)).select("trace_id", "idx", F.col(column).alias("v"))
    rows = settled(_baselines(good, segments, n, skip, far, max(8, look // 2), floor), "levels")
    for side in ("right", "left"):
        rows = settled(_grown(good, rows, n, walls, side, look, -(-int(expand_s * sr) // look), int(longest_s * sr), int(pad_s * sr), k, floor), f"{side}-ends")
    return runs.merged_overlapping(rows.drop("base"))


def low_edges(segments: DataFrame, samples: DataFrame, column: str, bad: str, most: int = 5, share: float = 0.25, around: int = 200, least: int = 10) -> DataFrame:
    """Segments with new_s and new_e, moved outwards over at most `most` samples that are missing or far too low.

    Low is below `share` of the median of the `around` nearest good samples from there outwards, if there are `least` of them.
    """
    good = settled(samples.where(~F.col(bad)).select("trace_id", "idx", F.col(column).alias("v")), "good")
    # the place among the trace's good samples, counted by chunk so that no trace is one task
    chunk = F.floor(F.col("idx") / rolling.CHUNK)
    sizes = good.groupBy("trace_id", chunk.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_first", F.sum("_n").over(Window.partitionBy("trace_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    good = good.withColumn("_c", chunk).join(sizes, ["trace_id", "_c"])
    good = settled(good.select("trace_id", "idx", "v", (F.col("_first") + F.row_number().over(Window.partitionBy("trace_id", "_c").orderBy("idx")) - 1).alias("g")), "numbered")
    out = segments
    for side in ("left", "right"):
        step = F.explode(F.sequence(F.lit(1), F.lit(most)))
        places = segments.select(*KEY, step.alias("i")).withColumn("idx", F.when(F.lit(side == "left"), F.col("s") - F.col("i")).otherwise(F.col("e") + F.col("i")))
        seen = places.join(samples.select("trace_id", "idx", F.col(bad).alias("_bad"), F.col(column).alias("_v")), ["trace_id", "idx"])
        own = seen.where("NOT _bad").join(good.select("trace_id", "idx", "g"), ["trace_id", "idx"])
        span = own.select(F.col("trace_id"), *KEY[1:], "i", "_v", (F.col("g") - around + 1 if side == "left" else F.col("g")).alias("_w0"), (F.col("g") if side == "left" else F.col("g") + around - 1).alias("_w1"))
        span = span.withColumn("_w0", F.greatest(F.col("_w0"), F.lit(0)))
        near = ranges.samples_in(good.select("trace_id", F.col("g").alias("idx"), "v"), span, s="_w0", e="_w1", bucket=rolling.CHUNK // 16)
        low = near.groupBy(*KEY, "i", "_v").agg(rolling.median("v").alias("_m"), F.count(F.lit(1)).alias("_k")).where((F.col("_k") >= least) & (F.col("_v") < share * F.col("_m"))).select(*KEY, "i")
        takes = seen.where("_bad").select(*KEY, "i").unionByName(low)
        order = Window.partitionBy(*KEY).orderBy("i")
        grown = takes.withColumn("_r", F.row_number().over(order)).where("_r = i").groupBy(*KEY).agg(F.max("i").alias(f"_{side}"))
        out = out.join(grown, KEY, "left")
    by = lambda c: F.coalesce(c, F.lit(0))
    return out.withColumns({"new_s": F.col("s") - by("_left"), "new_e": F.col("e") + by("_right")}).drop("_left", "_right")


def masked_references(segments: DataFrame, others: DataFrame, samples: DataFrame, column: str, reach: int, bad: str) -> DataFrame:
    """trace_id, s, e, a, b, level: the parts a to b of other segments within `reach` of a segment, and the level to put them at while it is rebuilt.

    The level is the median of the good samples within `reach` of the part, or the trace's if there are fewer than 8; a column `whole` of the samples, if there is one, is that
    median. With a column `seq` in both, other segments count if they come later or have none.
    """
    ordered = "seq" in segments.columns and "seq" in others.columns
    size = max(ranges.BUCKET, reach)
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    own, their = ([F.col("seq").alias("_seq")], [F.col("seq").alias("_later")]) if ordered else ([], [])
    left = segments.select(*KEY, *own, (F.col("s") - reach).alias("_w0"), (F.col("e") + reach).alias("_w1")).withColumn("_b", spread(F.col("_w0"), F.col("_w1")))
    right = others.select("trace_id", F.col("s").alias("_s"), F.col("e").alias("_e"), *their).withColumn("_b", spread(F.col("_s"), F.col("_e")))
    pairs = left.join(right, ["trace_id", "_b"]).where("_s <= _w1 AND _e >= _w0 AND NOT (_s = s AND _e = e)")
    pairs = pairs.where("_later IS NULL OR _later > _seq") if ordered else pairs
    parts = settled(pairs.select(*KEY, F.greatest("_s", F.greatest("_w0", F.lit(0))).cast("long").alias("a"), F.least("_e", "_w1").cast("long").alias("b")).distinct(), "parts")
    good = samples.where(~F.col(bad)).select("trace_id", "idx", F.col(column).alias("v"))
    spans = parts.select("trace_id", "a", "b").distinct().withColumns({"_w0": F.greatest(F.col("a") - reach, F.lit(0)), "_w1": F.col("b") + reach})
    near = ranges.samples_in(good, spans, s="_w0", e="_w1").where((F.col("idx") < F.col("a")) | (F.col("idx") > F.col("b")))
    near = near.groupBy("trace_id", "a", "b").agg(rolling.median("v").alias("_m"), F.count(F.lit(1)).alias("_k"))
    whole = samples.groupBy("trace_id").agg(F.first("whole").alias("_whole")) if "whole" in samples.columns else good.groupBy("trace_id").agg(rolling.median("v").alias("_whole"))
    rows = parts.join(near, ["trace_id", "a", "b"], "left").join(whole, "trace_id", "left")
    return rows.select(*KEY, "a", "b", F.when(F.col("_k") >= 8, F.col("_m")).otherwise(F.col("_whole")).alias("level"))


def guard(segments: DataFrame, samples: DataFrame, raw: str, rebuilt: str, bad: str, sr: float, around_s: float = 300.0, low: float = 0.2, high: float = 4.0, raw_factor: float = 1.1, around_factor: float = 2.0, floor: float = 0.5) -> DataFrame:
    """Segments with the verdict on what was rebuilt, and the greatest deviation that it should be pressed to.

    'energy': it moves more than the good samples it replaces and than its surroundings. 'alive': half or more of the segment was there
    and moved like its surroundings, so that it needn't be repaired. Else 'kept'.
    """
    rows = rolling.sized(samples).select("trace_id", "idx", "n", F.col(raw).alias("v"), F.col(rebuilt).alias("w"), F.col(bad).alias("_bad"))
    good = F.when(~F.col("_bad"), F.col("v"))
    inside = ranges.samples_in(rows, segments.select(*KEY)).groupBy(*KEY).agg(
        F.count(good).alias("_k"), F.when(F.count(good) > 3, F.stddev_pop(good)).alias("raw_std"), F.when(F.count("w") > 3, F.stddev_pop("w")).otherwise(0.0).alias("new_std"), F.avg(F.col("_bad").cast("double")).alias("_gone"),
        F.count_if(F.col("idx") <= F.col("n") - 2).alias("_n1"), (F.max(F.when(F.col("idx") <= F.col("n") - 2, F.col("v"))) > F.min(F.when(F.col("idx") <= F.col("n") - 2, F.col("v")))).alias("_moves"),
    )
    reach = int(around_s * sr)
    wide = segments.select(*KEY, F.greatest(F.col("s") - reach, F.lit(0)).alias("_w0"), (F.col("e") + reach).alias("_w1"))
    beside = ranges.samples_in(rows.where("NOT _bad").select("trace_id", "idx", "v"), wide, s="_w0", e="_w1").where((F.col("idx") < F.col("s")) | (F.col("idx") > F.col("e")))
    rows = inside.join(_levels(beside, KEY, "v").where("k >= 30").select(*KEY, "sc"), KEY, "left")
    # without enough good samples the deviation is unbounded: null
    rows = rows.withColumn("around_std", F.greatest(F.coalesce("sc", "raw_std"), F.lit(floor))).withColumn("around_std", F.when(F.col("sc").isNotNull() | F.col("raw_std").isNotNull(), F.col("around_std")))
    limit = F.greatest(raw_factor * F.col("raw_std"), around_factor * F.col("around_std"))
    energy = F.col("raw_std").isNotNull() & (F.col("new_std") > limit)
    alive = (F.col("_k") >= 30) & (F.col("_n1") >= 8) & F.col("_moves") & (F.col("_gone") <= 0.5) & (F.col("raw_std") / F.col("around_std")).between(low, high)
    verdict = F.when(energy, "energy").when(alive, "alive").otherwise("kept")
    return segments.join(rows.select(*KEY, "raw_std", "new_std", "around_std", verdict.alias("verdict"), (around_factor * F.col("around_std")).alias("most_std")), KEY)


def realigned(segments: DataFrame, samples: DataFrame, raw: str, rebuilt: str, bad: str, sr: float, side_s: float = 45.0, skip_s: tuple[float, float] = (10.0, 35.0), long_s: float = 60.0) -> DataFrame:
    """trace_id, s, e, idx, w of the segments' samples: what was rebuilt, on the line that its surroundings give, and pressed to most_std around it.

    segments have around_std and most_std. The line runs from the median of the good samples just before to that of those after, where what directly follows is
    skipped (more of it after a long segment). If the right is far from the left or much less steady, or isn't there, the line is level at the left's median; without a left, at the
    rebuilt segment's own.
    """
    good = samples.where(~F.col(bad)).select("trace_id", "idx", F.col(raw).alias("v"))
    side, skip = int(side_s * sr), F.when(runs.length() > int(long_s * sr), int(skip_s[1] * sr)).otherwise(int(skip_s[0] * sr))
    out = segments.select(*KEY, "around_std", "most_std")
    for name, low, high in (("l", F.col("s") - side, F.col("s") - 1), ("r", F.col("e") + 1 + skip, F.col("e") + skip + side)):
        wide = segments.select(*KEY, F.greatest(low, F.lit(0)).cast("long").alias("_w0"), high.cast("long").alias("_w1")).where("_w1 >= _w0")
        found = _levels(ranges.samples_in(good, wide, s="_w0", e="_w1"), KEY, "v").where("k >= 4")
        out = out.join(found.select(*KEY, F.col("m").alias(f"_m{name}"), F.col("sc").alias(f"_c{name}")), KEY, "left")
    inside = ranges.samples_in(samples.select("trace_id", "idx", F.col(rebuilt).alias("w")), out)
    t = (F.col("idx") - F.col("s")) / F.greatest(F.col("e") - F.col("s"), F.lit(1))
    fitted = inside.groupBy(*KEY).agg(rolling.median("w").alias("_own"), F.regr_slope("w", t).alias("_b"), F.regr_intercept("w", t).alias("_a"), F.avg("w").alias("_mean"))
    inside = inside.join(fitted, KEY)
    left, left_scale = F.coalesce("_ml", "_own"), F.when(F.col("_ml").isNull(), 0.0).otherwise(F.col("_cl"))
    right, right_scale = F.coalesce("_mr", left), F.when(F.col("_mr").isNull(), left_scale).otherwise(F.col("_cr"))
    unsteady = (right_scale > 0) & (left_scale > 0) & (right_scale > 3.0 * F.greatest(left_scale, F.lit(0.5)))
    clean = (F.abs(right - left) < 2.0 * F.greatest(F.col("around_std"), F.lit(0.5))) & ~unsteady
    line = left + F.when(clean, right - left).otherwise(0.0) * t
    moved = inside.withColumn("_line", line).withColumn("_x", F.col("w") - F.coalesce(F.col("_a") + F.col("_b") * t, F.col("_mean")) + F.col("_line"))
    spread = moved.groupBy(*KEY).agg(F.when(F.count("_x") > 3, F.stddev_pop("_x")).otherwise(0.0).alias("_std"))
    most = F.greatest(F.col("most_std"), F.lit(0.5))
    press = F.when((F.col("_std") > most) & (F.col("_std") > 1e-9), most / F.col("_std")).otherwise(1.0)
    return moved.join(spread, KEY).select(*KEY, "idx", (F.col("_line") + (F.col("_x") - F.col("_line")) * press).alias("w"))


def fade(position: Column, n: Column) -> Column:
    """0 at the first of n places, 1 at the last."""
    return position / F.greatest(n - 1, F.lit(1))


def crossfaded(segments: DataFrame, samples: DataFrame, raw: str, rebuilt: str, bad: str, sr: float, blend_s: float = 10.0, context_s: float = 30.0) -> DataFrame:
    """trace_id, s, e, idx, w of the segments' samples: at both edges what was rebuilt fades into the line that the good samples outside go on with.

    The line goes through up to three blends of good samples from `context_s` beside; with fewer than 4 that edge stays as rebuilt.
    """
    reach = int(context_s * sr)
    segs = segments.select(*KEY).withColumn("_n", F.least(F.lit(int(blend_s * sr)), F.floor(runs.length() / 4)))
    good = samples.where(~F.col(bad)).select("trace_id", "idx", F.col(raw).alias("_v"))
    out = segs
    for side in ("l", "r"):
        low, high = (F.greatest(F.col("s") - reach, F.lit(0)), F.col("s") - 1) if side == "l" else (F.col("e") + 1, F.col("e") + reach)
        wide = segs.select(*KEY, "_n", low.cast("long").alias("_w0"), high.cast("long").alias("_w1")).where("_w1 >= _w0 AND _n >= 2")
        near = ranges.samples_in(good, wide, s="_w0", e="_w1").withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("idx").desc() if side == "l" else F.col("idx"))))
        # places count from the edge: -1 is the nearest on the left, 0 on the right
        place = -F.col("_k") if side == "l" else F.col("_k") - 1
        line = near.where(F.col("_k") <= 3 * F.col("_n")).groupBy(*KEY).agg(F.regr_slope(F.col("_v"), place).alias(f"_b{side}"), F.regr_intercept(F.col("_v"), place).alias(f"_a{side}"), F.count(F.lit(1)).alias("_k"))
        out = out.join(line.where("_k >= 4").drop("_k"), KEY, "left")
    inside = ranges.samples_in(samples.select("trace_id", "idx", F.col(rebuilt).alias("w")), out)
    p, q, n = F.col("idx") - F.col("s"), F.col("e") - F.col("idx"), F.col("_n")
    left, right = F.col("_al") + F.col("_bl") * p, F.col("_ar") - F.col("_br") * (q + 1)
    mix = lambda template, place: template * (1 - fade(place, n)) + F.col("w") * fade(place, n)
    value = F.when((n >= 2) & (p < n), F.coalesce(mix(left, p), "w")).when((n >= 2) & (q < n), F.coalesce(mix(right, q), "w")).otherwise(F.col("w"))
    return inside.select(*KEY, "idx", value.alias("w"))
