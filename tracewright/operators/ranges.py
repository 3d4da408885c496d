"""Joins of samples and segments on intervals, as equi-joins on buckets of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def samples_in(samples: DataFrame, segments: DataFrame, how: str = "inner", s: str = "s", e: str = "e", bucket: int = BUCKET) -> DataFrame:
    """Pairs of a sample and a segment of its trace that holds it. A segment stands in each bucket that it touches, and a pair meets in one."""
    rest = [c for c in segments.columns if c != "trace_id"]
    right = segments.select(F.col("trace_id").alias("_k"), *(F.col(c).alias(f"_r_{c}") for c in rest), F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))).alias("_rb"))
    left = samples.withColumn("_b", F.floor(F.col("idx") / bucket))
    within = (F.col("trace_id") == F.col("_k")) & (F.col("_b") == F.col("_rb")) & (F.col("idx") >= F.col(f"_r_{s}")) & (F.col("idx") <= F.col(f"_r_{e}"))
    both = how not in ("left_semi", "left_anti")
    return left.join(right, within, how).select(*samples.columns, *(F.col(f"_r_{c}").alias(c) for c in rest if both))


def arrays_in(samples: DataFrame, segments: DataFrame, parts: dict[str, tuple[Column, Column]], value: Column | str = "v", keys: tuple[str, ...] = ("s", "e"), bucket: int = BUCKET) -> DataFrame:
    """trace_id, keys and an array for each part of a segment, from its first to its last place: the values that samples have there, in order. Segments without samples in any part are left out.

    Samples stand in blocks with an array each, and a segment meets blocks instead of samples: of a block, only what lies in its parts goes on.
    """
    keys = ["trace_id", *keys]
    held = samples.select("trace_id", F.floor(F.col("idx") / bucket).alias("_block"), F.struct("idx", (F.col(value) if isinstance(value, str) else value).alias("x")).alias("_item"))
    blocks = held.groupBy("trace_id", "_block").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    first, last, size = F.col("_items.idx")[0], F.element_at("_items.idx", -1), F.size("_items")
    gaps = F.when(last - first + 1 != size, F.col("_items.idx"))  # a block whose places aren't dense says which it has
    blocks = blocks.select("trace_id", "_block", F.col("_items.x").alias("_x"), first.alias("_first"), last.alias("_last"), gaps.alias("_places"))
    steps = lambda lo, hi: F.when(lo <= hi, F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))).otherwise(F.array().cast("array<bigint>"))
    ends = {name: (f"_lo{i}", f"_hi{i}") for i, name in enumerate(parts)}
    met = F.explode(F.array_distinct(F.concat(*(steps(lo, hi) for lo, hi in parts.values()))))
    wide = segments.select(*keys, *(c.cast("long").alias(n) for name, bounds in parts.items() for c, n in zip(bounds, ends[name])), met.alias("_block"))

    def piece(low: str, high: str) -> Column:
        start, end = F.greatest(low, "_first"), F.least(high, "_last")
        cut = F.slice("_x", (start - F.col("_first") + 1).cast("int"), (end - start + 1).cast("int"))
        some = F.filter("_x", lambda _, i: F.get("_places", i).between(F.col(low), F.col(high)))
        return F.when(start <= end, F.when(F.col("_places").isNull(), cut).otherwise(some))

    pieces = wide.join(blocks, ["trace_id", "_block"]).select(*keys, "_block", *(piece(*ends[name]).alias(name) for name in parts))
    whole = lambda name: F.flatten(F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("_block", name))))[name])
    tasks = 4 * samples.sparkSession.sparkContext.defaultParallelism  # said, since few bytes may be much work for those who read the arrays
    return pieces.repartition(tasks, *keys).groupBy(*keys).agg(*(whole(name).alias(name) for name in parts))


def _reached(left: DataFrame, right: DataFrame, keys: tuple[str, ...], at: str, least: str, how: str, s: str = "s", e: str = "e") -> DataFrame:
    """Rows of left for which, of right's segments of the same keys that start at or before `at`, the one that reaches furthest reaches `least`, or doesn't.

    A running maximum over both sides in order of place: no pair of segments is made, however many share a key.
    """
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    one = left.select(F.struct("*").alias("_row"), *named, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_end"))
    other = right.select(F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), *named, F.col(s).alias("_at"), F.lit(0).alias("_side"), F.col(e).cast("long").alias("_end"))
    before = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = one.unionByName(other).withColumn("_reach", F.max("_end").over(before)).where("_side = 1")
    hit = F.coalesce(F.col("_reach") >= F.col(f"_row.{least}"), F.lit(False))
    for i in range(len(keys)):
        hit &= F.col(f"_k{i}").isNotNull()
    return rows.where(hit if how == "left_semi" else ~hit).select("_row.*")


def overlapping(left: DataFrame, right: DataFrame, how: str, key: str = "trace_id", s: str = "s", e: str = "e") -> DataFrame:
    """Segments of left that share (left_semi) or don't share (left_anti) a place with one of right."""
    return _reached(left, right, (key,), e, s, how, s, e)


def covered(left: DataFrame, right: DataFrame, how: str, keys: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """Segments of left that lie (left_semi) or don't lie (left_anti) whole within one of right."""
    return _reached(left, right, keys, "s", "e", how)


def reference_windows(segments: DataFrame, n: DataFrame, reach: Column | int, gap: int) -> DataFrame:
    """Segments with the bounds of the reference before and after: b_s, b_e, a_s, a_e (empty if end < start)."""
    rows = segments.join(n, "trace_id").withColumn("_l", reach if isinstance(reach, Column) else F.lit(reach))
    return rows.withColumns({
        "b_s": F.greatest(F.lit(0), F.col("s") - gap - F.col("_l")).cast("long"), "b_e": (F.col("s") - gap - 1).cast("long"),
        "a_s": (F.col("e") + 1 + gap).cast("long"), "a_e": F.least(F.col("n") - 1, F.col("e") + gap + F.col("_l")).cast("long"),
    }).drop("_l")


def auto_reference(sr: float, share: float = 0.5, least_s: float = 120.0, most_s: float = 600.0) -> Column:
    """Reference length in samples for a segment: half its length between two bounds."""
    seconds = F.least(F.greatest((F.col("e") - F.col("s") + 1) / sr * share, F.lit(least_s)), F.lit(most_s))
    return F.rint(seconds * sr).cast("long")
