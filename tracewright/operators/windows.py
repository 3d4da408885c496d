"""Windows of a trace as rows: profiles, quiet stretches, boundaries, injected faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges
from .storage import settled


def windowed(df: DataFrame, width: int, hop: int) -> DataFrame:
    """Each sample once for every window [start, start + width) that holds it; starts are multiples of hop."""
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - width + 1) / hop))
    return df.withColumn("start", F.explode(F.sequence(first.cast("long"), F.floor(F.col("idx") / hop).cast("long")))).withColumn("start", F.col("start") * hop)


def profile(df: DataFrame, column: str, width: int, hop: int) -> DataFrame:
    """trace_id, start, rms and n of full windows."""
    rows = windowed(df, width, hop).groupBy("trace_id", "start").agg(F.sqrt(F.avg(F.col(column) * F.col(column))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") == width)


def quiet(profiles: DataFrame, width: int, at_most: Column, k: int) -> DataFrame:
    """Of the windows below a level, the k quietest of a trace that don't overlap: taken one after the other, so a fold over the trace's windows."""
    kept = profiles.where(F.col("rms") <= at_most)
    rows = kept.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("rms", "start"))).alias("all"))
    empty = F.array().cast("array<bigint>")

    def take(done: Column, x: Column) -> Column:
        free = ~F.exists(done, lambda s: F.abs(s - x["start"]) < width) & (F.size(done) < k)
        return F.when(free, F.concat(done, F.array(x["start"]))).otherwise(done)

    return rows.select("trace_id", F.posexplode(F.aggregate("all", empty, take)).alias("rank", "start"))


def two_sided_lines(segments: DataFrame, samples: DataFrame, reach: int, column: str) -> DataFrame:
    """Segments with the least-squares line through the samples within reach on both sides, on the axis of the segment's start."""
    wide = segments.withColumns({"w0": F.greatest(F.lit(0), F.col("s") - reach), "w1": F.col("e") + reach})
    pairs = ranges.samples_in(samples, wide, s="w0", e="w1").where((F.col("idx") < F.col("s")) | (F.col("idx") > F.col("e")))
    t = F.col("idx") - F.col("s")
    return pairs.groupBy(*segments.columns).agg(F.regr_slope(column, t).alias("slope"), F.regr_intercept(column, t).alias("level"), F.count(F.lit(1)).alias("n"))


def robust(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Per group: the robust scale, and the median difference between neighbours within six median sizes of one."""
    order = Window.partitionBy(*by).orderBy("idx")
    rows = df.withColumn("_d", F.col(column) - F.lag(column).over(order))
    p = lambda x: F.percentile(x, F.lit(0.5))
    mid = rows.groupBy(*by).agg(p(column).alias("_m"), p("_d").alias("_s"), p(F.abs("_d")).alias("_a"), F.stddev_pop(column).alias("_std"))
    mad = rows.join(mid, by).groupBy(*by, "_s", "_a", "_std").agg(p(F.abs(F.col(column) - F.col("_m"))).alias("_mad"))
    scale = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise(F.greatest("_std", F.lit(1e-12)))
    slope = F.when(F.col("_a") > 1e-12, F.greatest(F.least(F.col("_s"), 6 * F.col("_a")), -6 * F.col("_a"))).otherwise(F.col("_s"))
    return mad.select(*by, scale.alias("scale"), slope.alias("slope"))


def injected(kind: str, x: Column, place: Column, s: int, e: int) -> Column:
    """A fault of a kind between two places."""
    inside = place.between(s, e)
    value = {"dropout": F.lit(0.0), "step": x + 200.0, "saturation": F.lit(1023.0), "spike": F.when(place == s, x + 500.0).otherwise(x)}[kind]
    return F.when(inside, value).otherwise(x)


def oscillation_clusters(segments: DataFrame, samples: DataFrame, gap: int, least: int, reach: int, column: str = "x", spread: float = 12.0, ratio: float = 1.3, floor: float = 0.5) -> DataFrame:
    """Clusters of segments less than `gap` apart with more than `least` samples in their segments, and whether they swing rather than step.

    They swing if their path is longer than `spread` times their largest move, and if they are livelier, by the median
    deviation, than `ratio` times the samples within `reach` around them (at least `floor`); both need 8 samples.
    """
    from . import runs

    key = ["trace_id", "s", "e"]
    clusters = runs.merged(segments.select(*key), gap - 1)
    starts = segments.select("trace_id", F.col("s").alias("idx"), runs.length().alias("_len"))
    clusters = ranges.samples_in(starts, clusters).groupBy(*key).agg(F.sum("_len").alias("total")).where(F.col("total") > least)
    x, median = F.col(column), lambda c: F.percentile(c, F.lit(0.5))
    points = samples.select("trace_id", "idx", column)
    order = Window.partitionBy(*key).orderBy("idx")
    inside = ranges.samples_in(points, clusters).withColumn("_d", F.abs(x - F.lag(column).over(order)))
    own = inside.groupBy(*key, "total").agg(F.sum("_d").alias("path"), F.max("_d").alias("most"), median(column).alias("_m"), F.count(F.lit(1)).alias("_n"))
    own = ranges.samples_in(points, own).groupBy(*key, "total", "path", "most", "_n").agg((1.4826 * median(F.abs(x - F.col("_m")))).alias("mad"))
    wide = clusters.select(*key, (F.col("s") - reach).alias("_w0"), (F.col("e") + reach).alias("_w1"))
    beside = ranges.samples_in(points, wide, s="_w0", e="_w1").where((F.col("idx") < F.col("s")) | (F.col("idx") > F.col("e")))
    middle = beside.groupBy(*key).agg(median(column).alias("_c"), F.count(F.lit(1)).alias("_around"))
    around = beside.join(middle, key).groupBy(*key, "_around").agg(F.greatest(1.4826 * median(F.abs(x - F.col("_c"))), F.lit(floor)).alias("around"))
    swings = (F.col("path") > spread * F.col("most")) & (F.col("mad") > ratio * F.col("around")) & (F.col("_n") >= 8) & (F.col("_around") >= 8)
    return own.join(around, key, "left").select(*key, "total", "path", "most", "mad", "around", F.coalesce(swings, F.lit(False)).alias("swings"))



def adaptive_bounds(segments: DataFrame, samples: DataFrame, reach: int, column: str, k: float = 0.5) -> DataFrame:
    """Segments with new_s and new_e: the nearest places outside where the samples are within k deviations of each side's own line; null if none is."""
    out = segments
    for side in ("left", "right"):
        low, high = (F.col("s") - reach, F.col("s") - 1) if side == "left" else (F.col("e") + 1, F.col("e") + reach)
        wide = segments.withColumns({"w0": F.greatest(F.lit(0), low).cast("long"), "w1": high.cast("long")}).where("w1 >= w0")
        near = ranges.samples_in(samples.select("trace_id", "idx", column), wide, s="w0", e="w1").withColumn("t", F.col("idx") - F.col("s"))
        keys = segments.columns
        line = near.groupBy(*keys).agg(F.regr_slope(column, "t").alias("b"), F.regr_intercept(column, "t").alias("a"))
        off = near.join(line, keys).withColumn("d", F.col(column) - F.col("a") - F.col("b") * F.col("t"))
        spread = off.groupBy(*keys).agg(F.stddev_pop("d").alias("sd"))
        ok = off.join(spread, keys).where(F.abs("d") <= k * F.col("sd"))
        found = ok.groupBy(*keys).agg((F.max("idx") if side == "left" else F.min("idx")).alias("new_s" if side == "left" else "new_e"))
        out = out.join(found, keys, "left")
    return out


def healthy_band(df: DataFrame, width: int, column: str) -> DataFrame:
    """Differences of mean and spread between all pairs of a trace's full, separate windows, one row a pair.

    Pairs are what the natural band is made of; they grow with the square of a trace's windows, so width bounds them.
    """
    w = df.groupBy("trace_id", F.floor(F.col("idx") / width).alias("k")).agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("d"), F.count(F.lit(1)).alias("n")).where(F.col("n") == width)
    a, b = w.select("trace_id", F.col("k").alias("i"), F.col("m").alias("ma"), F.col("d").alias("da")), w.select("trace_id", F.col("k").alias("j"), F.col("m").alias("mb"), F.col("d").alias("db"))
    return a.join(b, "trace_id").where("i < j").select("trace_id", "i", "j", F.abs(F.col("ma") - F.col("mb")).alias("d_mean"), F.abs(F.col("da") - F.col("db")).alias("d_std"))


#: Windows of a block whose pairs with another block are made in one task, and ranges of value that differences are counted by.
PAIR_BLOCK, DIFFERENCE_RANGES = 512, 4096


def _paired_in_blocks(w: DataFrame, block: int) -> DataFrame:
    """All pairs i < j of a trace's windows (trace_id, i from 0, m, d): trace_id, d_mean, d_std. Two blocks of windows meet under a key of their own, so that no trace is one task."""
    at, last = F.floor(F.col("i") / block), F.floor((F.col("n") - 1) / block)
    rows = w.withColumn("_b", at)
    one = rows.select("trace_id", F.col("_b").alias("_p"), F.explode(F.sequence("_b", last)).alias("_q"), "i", F.col("m").alias("ma"), F.col("d").alias("da"))
    other = rows.select("trace_id", F.explode(F.sequence(F.lit(0).cast("long"), "_b")).alias("_p"), F.col("_b").alias("_q"), F.col("i").alias("j"), F.col("m").alias("mb"), F.col("d").alias("db"))
    tasks = max(64, 4 * w.sparkSession.sparkContext.defaultParallelism)
    both = one.repartition(tasks, "trace_id", "_p", "_q").hint("shuffle_hash").join(other.repartition(tasks, "trace_id", "_p", "_q"), ["trace_id", "_p", "_q"])
    return both.where("i < j").select("trace_id", F.abs(F.col("ma") - F.col("mb")).alias("d_mean"), F.abs(F.col("da") - F.col("db")).alias("d_std"))


def healthy_quantiles(df: DataFrame, width: int, column: str, wanted: dict[str, tuple[str, float]], block: int = PAIR_BLOCK, parts: int = DIFFERENCE_RANGES) -> DataFrame:
    """trace_id, n_pairs and exact quantiles of the differences that healthy_band lists, interpolated: name -> ('d_mean' or 'd_std', share).

    Pairs are made twice and never shuffled or kept. First they are counted by ranges of value; then those of the ranges that hold a wanted rank are counted by value, and the value at
    the rank is looked up among them.
    """
    w = df.groupBy("trace_id", F.floor(F.col("idx") / width).alias("k")).agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("d"), F.count(F.lit(1)).alias("n")).where(F.col("n") == width)
    place = Window.partitionBy("trace_id").orderBy("k")
    w = settled(w.select("trace_id", (F.row_number().over(place) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("trace_id")).alias("n"), "m", "d"), "healthy")
    spans = w.groupBy("trace_id").agg((F.max("m") - F.min("m")).alias("_sm"), (F.max("d") - F.min("d")).alias("_sd"))
    pairs = _paired_in_blocks(w, block).join(F.broadcast(spans), "trace_id")
    part = lambda x, span: F.least(F.lit(parts - 1), F.coalesce(F.floor(F.try_divide(F.col(x), F.col(span)) * parts), F.lit(0))).cast("int")
    kinds = pairs.select("trace_id", F.explode(F.array(F.struct(F.lit("d_mean").alias("of"), part("d_mean", "_sm").alias("part"), F.col("d_mean").alias("x")), F.struct(F.lit("d_std").alias("of"), part("d_std", "_sd").alias("part"), F.col("d_std").alias("x")))).alias("y")).select("trace_id", "y.*")
    counts = kinds.groupBy("trace_id", "of", "part").agg(F.count(F.lit(1)).alias("c"))
    along = Window.partitionBy("trace_id", "of").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select("*", F.sum("c").over(along).alias("upto"), F.sum("c").over(Window.partitionBy("trace_id", "of")).alias("n_pairs"))
    names = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(of).alias("of"), F.lit(float(share)).alias("share")) for name, (of, share) in wanted.items()))
    ranks = counts.withColumn("w", F.explode(F.filter(names, lambda z: z["of"] == F.col("of")))).withColumn("at", F.col("w.share") * (F.col("n_pairs") - 1))
    ranks = ranks.withColumn("rank", F.explode(F.array(F.floor("at"), F.ceil("at")))).where("rank >= upto - c AND rank < upto")
    ranks = settled(ranks.select("trace_id", "of", "part", "n_pairs", F.col("w.name").alias("name"), "at", "rank", (F.col("upto") - F.col("c")).alias("before")), "ranks")
    held = kinds.join(F.broadcast(ranks.select("trace_id", "of", "part").distinct()), ["trace_id", "of", "part"]).groupBy("trace_id", "of", "part", "x").agg(F.count(F.lit(1)).alias("c"))
    inside = Window.partitionBy("trace_id", "of", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("upto", F.sum("c").over(inside))
    found = held.join(F.broadcast(ranks), ["trace_id", "of", "part"]).where("rank - before >= upto - c AND rank - before < upto")
    low, high, share = F.min("x"), F.max("x"), F.first("at") - F.floor(F.first("at"))
    values = found.groupBy("trace_id", "n_pairs", "name").agg((low + (high - low) * share).alias("value"))
    return values.groupBy("trace_id", "n_pairs").agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted))
