"""Runs of samples and segments made of them. Segments are rows (trace_id, s, e, ...) with inclusive ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges
from .rolling import CHUNK
from .storage import settled


def state_runs(df: DataFrame, state: str, chunk: int = CHUNK) -> DataFrame:
    """trace_id, s, e, state: the longest runs of equal values (nulls are equal).

    Runs are found in each chunk; only those that touch a chunk's edge are then put in order along the trace and joined.
    """
    rows = df.select("trace_id", "idx", F.col(state).alias("state"), F.floor(F.col("idx") / chunk).alias("_chunk"))
    inside = Window.partitionBy("trace_id", "_chunk").orderBy("idx")
    new = ~F.col("state").eqNullSafe(F.lag("state").over(inside)) | (F.col("idx") - F.lag("idx").over(inside) > 1) | F.lag("idx").over(inside).isNull()
    rows = rows.withColumn("_run", F.sum(new.cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy("trace_id", "_chunk", "_run").agg(F.min("idx").alias("s"), F.max("idx").alias("e"), F.first("state").alias("state")).drop("_run", "_chunk")
    edge = (F.col("s") % chunk == 0) | (F.col("e") % chunk == chunk - 1)
    order = Window.partitionBy("trace_id").orderBy("s")
    apart = ~F.col("state").eqNullSafe(F.lag("state").over(order)) | (F.col("s") != F.lag("e").over(order) + 1) | F.lag("e").over(order).isNull()
    joined = pieces.where(edge).withColumn("_group", apart.cast("int")).withColumn("_group", F.sum("_group").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("trace_id", "_group").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("state").alias("state")).drop("_group")
    return pieces.where(~edge).unionByName(joined).select("trace_id", "s", "e", "state")


def runs(df: DataFrame, flag: str) -> DataFrame:
    """trace_id, s, e of the runs where the flag holds."""
    held = df.withColumn("_flag", F.coalesce(F.col(flag), F.lit(False)))
    return state_runs(held, "_flag").where("state").drop("state")


def length() -> Column:
    return F.col("e") - F.col("s") + 1


def _merged(segments: DataFrame, apart, first: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy("trace_id").orderBy("s", "e", *first)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("e").over(before)
    rows = segments.withColumn("_new", (reach.isNull() | apart(F.col("s"), reach)).cast("int"))
    rows = rows.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    keep = [F.min_by(c, F.struct("s", "e", *first)).alias(c) for c in first]
    return rows.groupBy("trace_id", "_group").agg(F.min("s").alias("s"), F.max("e").alias("e"), *keep).drop("_group")


def merged(segments: DataFrame, gap: int) -> DataFrame:
    """Segments joined where the next one starts at most `gap` after the last end."""
    return _merged(segments, lambda s, reach: s - reach > gap, ())


def merged_overlapping(segments: DataFrame, keep: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Segments joined where they share a sample; the first one's kind stays."""
    return _merged(segments, lambda s, reach: s > reach, keep)


def merged_selections(selections: DataFrame) -> DataFrame:
    """Ranges of time (trace_id, s, e in seconds) joined where they overlap or touch; empty and reversed ones go."""
    return _merged(selections.where("e > s"), lambda s, reach: s > reach, ())


#: Samples of a chunk of segments that is folded at once.
FOLD_CHUNK = 1 << 13
_SPAN = "struct<s:bigint,e:bigint>"


def merged_in_order(segments: DataFrame, joins: Callable[[Column, Column], Column], chunk: int = FOLD_CHUNK) -> DataFrame:
    """Segments joined from left to right where joins(what is open, the next one) holds; the condition may depend on all that is merged so far.

    A chunk's summary is the segment that it leaves open, given the one that it was handed. All chunks are first folded as if handed nothing, and then again with what the chunk before
    left open, until no chunk leaves anything else than it did: once, unless a segment grows through a whole chunk. Only summaries are ordered along a trace.
    """

    def fold(entry: Column, every: Column) -> Column:
        """The joined segments of a chunk in order, the last of them open."""
        start = F.when(entry.isNull(), F.array().cast(f"array<{_SPAN}>")).otherwise(F.array(entry))

        def step(done: Column, x: Column) -> Column:
            last = F.element_at(done, -1)
            grown = F.struct(last["s"].alias("s"), F.greatest(x["e"], last["e"]).alias("e"))
            return F.when(F.size(done) == 0, F.array(x)).when(joins(last, x), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

        return F.aggregate(every, start, step)

    each = F.struct(F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    rows = segments.groupBy("trace_id", F.floor(F.col("s") / chunk).alias("c")).agg(F.array_sort(F.collect_list(each)).alias("all"))
    rows = settled(rows.select("*", F.lit(None).cast(_SPAN).alias("entry"), F.element_at(fold(F.lit(None).cast(_SPAN), F.col("all")), -1).alias("open")), "folds")
    before = Window.partitionBy("trace_id").orderBy("c")
    while True:
        handed = rows.select("trace_id", "c", F.lag("open").over(before).alias("handed"))
        late = rows.join(handed, ["trace_id", "c"]).where(~F.col("handed").eqNullSafe(F.col("entry")))
        if late.isEmpty():
            break
        again = rows.join(handed, ["trace_id", "c"])
        same = F.col("handed").eqNullSafe(F.col("entry"))
        opened = F.when(same, F.col("open")).otherwise(F.element_at(fold(F.col("handed"), F.col("all")), -1))
        rows = settled(again.select("trace_id", "c", "all", F.col("handed").alias("entry"), opened.alias("open")), "folds")
    last = F.lead("c").over(before).isNull()
    done = rows.select("trace_id", last.alias("_last"), fold(F.col("entry"), F.col("all")).alias("done"))
    kept = F.when(F.col("_last"), F.col("done")).otherwise(F.slice("done", 1, F.size("done") - 1))
    return done.select("trace_id", F.explode(kept).alias("x")).select("trace_id", "x.s", "x.e")


def reference_length(n: Column, sr: float, least_s: float = 120.0, most_s: float = 600.0, share: float = 0.5) -> Column:
    """The seconds of reference that a segment of n samples needs."""
    return F.least(F.greatest(n / sr * share, F.lit(least_s)), F.lit(most_s))


def _size(x: Column) -> Column:
    return x["e"] - x["s"] + 1


def merged_by_reference(segments: DataFrame, sr: float, least_s: float = 120.0, most_s: float = 600.0, share: float = 0.5, longest_s: float = 1800.0, chunk: int = FOLD_CHUNK) -> DataFrame:
    """Segments joined where the gap is within the reference that the segment so far needs, up to a longest merge.

    A merge never changes an earlier gap, so that one pass from the left finds what repeated passes would.
    """

    def joins(last: Column, x: Column) -> Column:
        allowed = F.floor(reference_length(_size(last), sr, least_s, most_s, share) * sr)
        return (x["s"] - last["e"] <= allowed) & ((F.greatest(x["e"], last["e"]) - last["s"] + 1) / sr <= longest_s)

    return merged_in_order(segments, joins, chunk)


def merged_by_need(segments: DataFrame, sr: float, least_s: float = 120.0, most_s: float = 600.0, share: float = 0.5, between_s: float = 2.0, chunk: int = FOLD_CHUNK) -> DataFrame:
    """trace_id, s, e, m_s, m_e: segments with the unit that they are rebuilt in; only s to e is to be written back.

    Neighbours are one unit where the gap doesn't leave room for both references, of what is merged so far and of the next one, and between_s between them.
    """

    def joins(last: Column, x: Column) -> Column:
        need = reference_length(_size(last), sr, least_s, most_s, share) + reference_length(_size(x), sr, least_s, most_s, share) + between_s
        return (x["s"] - last["e"] - 1) / sr < need

    units = settled(merged_in_order(segments, joins, chunk), "units").select("trace_id", F.col("s").alias("m_s"), F.col("e").alias("m_e"))
    held = ranges.samples_in(segments.select("trace_id", F.col("s").alias("idx"), F.col("e").alias("_e")), units, s="m_s", e="m_e")
    return held.select("trace_id", F.col("idx").alias("s"), F.col("_e").alias("e"), "m_s", "m_e")


def padded(segments: DataFrame, n: DataFrame, sr: float, short_s: float = 10.0, pad_short: int = 33, pad_long: int = 198) -> DataFrame:
    """Segments widened: short ones by pad_short, others by a twentieth of their length between pad_long and twice that; cut at the trace's ends."""
    pad = F.when(length() <= short_s * sr, F.lit(pad_short)).otherwise(F.least(F.lit(2 * pad_long), F.greatest(F.lit(pad_long), F.floor(length() / 20))))
    rows = segments.join(n, "trace_id").withColumn("_pad", pad)
    return rows.withColumns({"s": F.greatest(F.lit(0), F.col("s") - F.col("_pad")).cast("long"), "e": F.least(F.col("n") - 1, F.col("e") + F.col("_pad")).cast("long")}).drop("_pad", "n")


def split_long(segments: DataFrame, longest: int, missing: str = "missing_share") -> DataFrame:
    """role and kind of over-long segments: a gap if mostly missing, else consecutive blocks; other segments stay."""
    over = length() > longest
    gap = over & (F.col(missing) > 0.5)
    starts = F.when(over & ~gap, F.sequence("s", "e", F.lit(longest).cast("long"))).otherwise(F.array("s"))
    rows = segments.withColumn("role", F.when(gap, "gap").otherwise("repair")).withColumn("_cut", over & ~gap).withColumn("_start", F.explode(starts))
    end = F.when(F.col("_cut"), F.least(F.col("_start") + longest - 1, F.col("e"))).otherwise(F.col("e"))
    return rows.withColumn("e", end).withColumn("s", F.col("_start")).drop("_start", "_cut")
