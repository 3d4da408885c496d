"""Stretches within segments whose samples are there but away from the segment's level, with their decaying tails.

Samples are (trace_id, idx, v, bad), segments (trace_id, s, e). A tail grows window by window from a stretch's edge while a window still moves or stands off; windows are tested in
blocks, and only stretches that pass a whole block go on to the next one, which is four times as long. So the work follows the growth, and the number of jobs its logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges, rolling, runs
from .storage import settled

#: Windows of the first block.
FIRST_BLOCK = 16


def _block(active: DataFrame, samples: DataFrame, keys: list[str], side: str, width: int, windows: int, passes: Column) -> DataFrame:
    """active (keys, at, room, ...) moved on by the windows that pass, with `going`: whether all of a full block did and room is left."""
    many = F.least(F.lit(windows), F.ceil(F.col("room") / width)).cast("int")
    tried = active.where("room > 0").withColumn("i", F.explode(F.sequence(F.lit(1), many)))
    far, near = F.least(F.col("i") * width, F.col("room")), (F.col("i") - 1) * width
    w0, w1 = (F.col("at") - far, F.col("at") - near - 1) if side == "left" else (F.col("at") + near + 1, F.col("at") + far)
    tried = tried.withColumns({"_w0": w0.cast("long"), "_w1": w1.cast("long"), "_far": far.cast("long")})
    good = samples.where(~F.col("bad")).select("trace_id", "idx", "v")
    seen = ranges.samples_in(good, tried.select("trace_id", *keys[1:], "i", "_w0", "_w1"), s="_w0", e="_w1").groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("n"), (F.max("v") - F.min("v")).alias("span"), rolling.median("v").alias("middle"))
    tested = tried.join(seen, [*keys, "i"], "left").withColumn("_ok", F.coalesce((F.col("n") >= 2) & passes, F.lit(False)))
    stop = F.coalesce(F.min(F.when(~F.col("_ok"), F.col("i"))), F.max("i") + 1)
    ends = tested.groupBy(*keys).agg(stop.alias("_stop"), F.max("i").alias("_last"), F.map_from_entries(F.collect_list(F.struct("i", "_far"))).alias("_fars"))
    moved = active.join(ends, keys, "left").withColumn("_by", F.coalesce(F.element_at("_fars", (F.col("_stop") - 1).cast("int")), F.lit(0)))
    whole = F.coalesce(F.col("_stop") > F.col("_last"), F.lit(False))
    step = -F.col("_by") if side == "left" else F.col("_by")
    rows = moved.withColumns({"at": F.col("at") + step, "room": F.col("room") - F.col("_by")})
    return rows.withColumn("going", whole & (F.col("room") > 0)).drop("_stop", "_last", "_fars", "_by")


def grown(stretches: DataFrame, samples: DataFrame, keys: list[str], width: int, passes: Column, low: str, high: str, first: int = FIRST_BLOCK) -> DataFrame:
    """Stretches (keys, s, e, ...) with both ends moved outwards to low and high at most, window by window of `width` samples while `passes` holds.

    keys: trace_id first, which name a stretch. passes may use n, span and middle of a window's good samples (two at least) and the stretch's columns.
    """
    out = stretches
    for side, end, room in (("left", "s", F.col("s") - F.col(low)), ("right", "e", F.col(high) - F.col("e"))):
        active, done, windows = settled(stretches.withColumns({"at": F.col(end), "room": room}), "growing"), [], first
        while not active.isEmpty():
            block = settled(_block(active, samples, keys, side, width, windows, passes), "grown")
            done.append(block.where("NOT going").select(*keys, F.col("at").alias(f"_{side}")))
            active, windows = block.where("going").drop("going"), windows * 4
        for k, part in enumerate(done):
            ends = part if not k else ends.unionByName(part)
        out = out.join(ends, keys) if done else out.withColumn(f"_{side}", F.col(end))
    return settled(out.select(*(c for c in stretches.columns if c not in ("s", "e")), F.col("_left").cast("long").alias("s"), F.col("_right").cast("long").alias("e")), "tails")


def anomaly_runs(samples: DataFrame, segments: DataFrame, sr: float, share: float = 0.08, least: float = 15.0, join: int = 30, span_s: float = 1.0, most_span: float = 12.0, bridge_s: float = 8.0, first: int = FIRST_BLOCK) -> DataFrame:
    """trace_id, seg_s, seg_e, s, e: stretches of good samples far from the median of their segment's.

    Far is beyond `share` of the median, `least` at least. Stretches up to `join` places apart are one; each grows while a window of span_s spans over most_span or stands off by half of that
    distance (8 at least); those that then touch are one, and so are those up to bridge_s apart. Segments with fewer than 10 good samples have none.
    """
    names = ["trace_id", "seg_s", "seg_e"]
    segs = segments.select("trace_id", F.col("s").alias("seg_s"), F.col("e").alias("seg_e"))
    inside = settled(ranges.samples_in(samples.select("trace_id", "idx", "v", "bad"), segs, s="seg_s", e="seg_e"), "inside")
    levels = inside.where(~F.col("bad")).groupBy(*names).agg(rolling.median("v").alias("med"), F.count(F.lit(1)).alias("_n")).where("_n >= 10").drop("_n")
    levels = settled(levels.withColumn("thr", F.greatest(F.col("med") * share, F.lit(least))), "levels")
    # each segment is a trace of its own
    key = F.struct(*names)
    own = inside.join(levels, names).select(key.alias("trace_id"), "idx", (~F.col("bad") & (F.abs(F.col("v") - F.col("med")) > F.col("thr"))).alias("off"))
    found = runs.merged(runs.runs(own, "off"), join).select("trace_id.*", "s", "e")
    found = settled(found.join(levels, names).withColumn("first_s", F.col("s")), "stretches")
    width = max(3, int(span_s * sr))
    stands_off = F.abs(F.col("middle") - F.col("med")) > F.greatest(F.col("thr") * 0.5, F.lit(8.0))
    wide = grown(found, samples, [*names, "first_s"], width, (F.col("span") > most_span) | stands_off, "seg_s", "seg_e", first)
    # in the order of what they grew from; what touches joins the stretch before, whose beginning stays
    order = Window.partitionBy(*names).orderBy("first_s")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = wide.withColumn("_new", (reach.isNull() | (F.col("s") > reach + 1)).cast("int"))
    rows = rows.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy(*names, "_group").agg(F.min_by("s", "first_s").alias("s"), F.max("e").alias("e"))
    bridged = runs.merged(rows.select(key.alias("trace_id"), "s", "e"), int(bridge_s * sr) + 1)
    return bridged.select("trace_id.*", "s", "e")
