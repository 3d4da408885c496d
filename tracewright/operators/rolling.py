"""Windows over neighbouring samples of a trace, in chunks, so that a long trace is not one task.

Samples are rows (trace_id, idx, ...) with idx dense from 0. A window of fixed reach needs only the rows near it: each
row goes to its own chunk and, near an edge, to the next one too. Windows are partitioned by trace and chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def lengths(df: DataFrame) -> DataFrame:
    """trace_id and n, the number of samples."""
    return df.groupBy("trace_id").agg((F.max("idx") + 1).alias("n"))


def sized(df: DataFrame) -> DataFrame:
    """df with n, so that windows with filled-in edges needn't count again."""
    return df if "n" in df.columns else df.join(lengths(df), "trace_id")


def _images(edges: str | None, before: int, after: int) -> Column:
    """Where a row stands, with the places outside the trace that it fills in."""
    i, n = F.col("idx"), F.col("_n")
    if edges == "reflect":  # d c b a | a b c d | d c b a
        k = (F.lit(before + after) / (2 * n)).cast("int") + 1
        places = F.flatten(F.transform(F.sequence(-k, k), lambda m: F.array(i + 2 * n * m, -1 - i + 2 * n * m)))
        # nearly all rows have no image: only those within reach of an end look for theirs
        return F.when((i >= before) & (i < n - after), F.array(i.cast("long"))).otherwise(F.filter(places, lambda p: (p >= -before) & (p < n + after)))
    first = F.when(i == 0, F.sequence(F.lit(-before).cast("long"), F.lit(-1).cast("long"))) if before else None
    last = F.when(i == n - 1, F.sequence(n, n + after - 1)) if after else None
    none = F.array().cast("array<bigint>")
    return F.concat(F.array(i), *(F.coalesce(x, none) for x in (first, last) if x is not None))


def _spread_out(df: DataFrame, before: int, after: int, edges: str | None, chunk: int) -> DataFrame:
    """Rows with _at, their place or one outside the trace that they fill in, and _chunk, each chunk that has a window over them."""
    placed = sized(df).withColumn("_n", F.col("n")).withColumn("_at", F.explode(_images(edges, before, after))) if edges else df.withColumn("_at", F.col("idx"))
    low, high = F.floor((F.col("_at") - after) / chunk), F.floor((F.col("_at") + before) / chunk)
    return placed.withColumn("_chunk", F.explode(F.sequence(low, high)))


def _own(chunk: int) -> Column:
    return (F.col("_at") == F.col("idx")) & (F.floor(F.col("idx") / chunk) == F.col("_chunk"))


def rolled(df: DataFrame, new: dict[str, Column], before: int, after: int, edges: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """df with aggregates over the rows from `before` back to `after` on.

    new: aggregates by name, as over(...) takes them. edges: 'reflect' or 'edge' fills in rows outside the trace;
    None lets windows end with the trace. A column n, if there is one, is the trace's length.
    """
    rows = _spread_out(df, before, after, edges, chunk)
    frame = Window.partitionBy("trace_id", "_chunk").orderBy("_at").rowsBetween(-before, after)
    rows = rows.select("*", *(a.over(frame).alias(n) for n, a in new.items()))
    return rows.where(_own(chunk)).select(*(n for n in df.columns if n not in new), *new)


def rolling_sum(df: DataFrame, column: str, before: int, after: int, out: str, edges: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Sum of the rows from `before` back to `after` on; wide windows are differences of running sums within the chunk."""
    if before + after < 48:
        return rolled(df, {out: F.sum(column)}, before, after, edges, chunk)
    rows = _spread_out(df, before, after, edges, chunk)
    part = Window.partitionBy("trace_id", "_chunk")
    order = part.orderBy("_at")
    rows = rows.withColumn("_run", F.sum(F.coalesce(F.col(column), F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum(F.coalesce(F.col(column), F.lit(0.0))).over(part)
    upto, gone = F.coalesce(F.lead("_run", after).over(order), total) if after else F.col("_run"), F.coalesce(F.lag("_run", before + 1).over(order), F.lit(0.0))
    rows = rows.withColumn(out, upto - gone)
    return rows.where(_own(chunk)).select(*(n for n in df.columns if n != out), out)


def median(x: Column | str) -> Column:
    return F.percentile(x, F.lit(0.5))


def rolling_median(df: DataFrame, column: str, width: int, out: str, edges: str | None = "reflect") -> DataFrame:
    """Median over an odd width around each sample; nulls don't count. Sorting a short list is much cheaper than a percentile per frame."""
    df = rolled(df, {"_near": F.collect_list(column)}, width // 2, width // 2, edges)
    near, n = F.sort_array("_near"), F.size("_near")
    middle = (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2
    return df.withColumn(out, middle).drop("_near")


def rolling_mean(df: DataFrame, column: str, width: int, out: str, edges: str | None = "reflect") -> DataFrame:
    """Mean over `width` samples; of an even width one more lies before than after. Values aren't null."""
    return rolling_sum(df, column, width // 2, (width - 1) // 2, out, edges).withColumn(out, F.col(out) / width)


def rolling_rms(df: DataFrame, column: str, width: int, out: str) -> DataFrame:
    df = rolling_mean(df.withColumn("_square", F.col(column) * F.col(column)), "_square", width, out)
    return df.withColumn(out, F.sqrt(F.greatest(F.col(out), F.lit(0.0)))).drop("_square")


def boxcar(df: DataFrame, column: str, width: int, out: str) -> DataFrame:
    """Moving average with zeros outside the trace."""
    return rolling_sum(df, column, width // 2, (width - 1) // 2, out).withColumn(out, F.col(out) / width)


def rolling_kurtosis(df: DataFrame, column: str, half: int, out: str) -> DataFrame:
    """Excess kurtosis over [i - half, i + half), cut at the ends; 0 for fewer than 4 samples or no spread."""
    df = rolled(df, {out: F.kurtosis(column), "_count": F.count(column), "_spread": F.stddev_pop(column)}, half, half - 1)
    return df.withColumn(out, F.when((F.col("_count") < 4) | (F.col("_spread") < 1e-12), 0.0).otherwise(F.col(out))).drop("_count", "_spread")


def dilated(df: DataFrame, flag: str, out: str, by: int = 1) -> DataFrame:
    return rolled(df, {out: F.max(flag)}, by, by)


def shifted(df: DataFrame, new: dict[str, tuple[str, int]]) -> DataFrame:
    """Values of other places: name -> (column, steps), -1 for the sample before."""
    reach = max(abs(k) for _, k in new.values())
    chunk = CHUNK
    rows = df.withColumn("_chunk", F.explode(F.sequence(F.floor((F.col("idx") - reach) / chunk), F.floor((F.col("idx") + reach) / chunk))))
    order = Window.partitionBy("trace_id", "_chunk").orderBy("idx")
    rows = rows.select("*", *((F.lag(c, -k) if k < 0 else F.lead(c, k)).over(order).alias(n) for n, (c, k) in new.items()))
    return rows.where(F.floor(F.col("idx") / chunk) == F.col("_chunk")).drop("_chunk")


def per_trace(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with aggregates of the whole trace on every row."""
    return df.join(df.groupBy("trace_id").agg(*(a.alias(n) for n, a in aggregates.items())), "trace_id")


def mad_scale(df: DataFrame, column: str, out: str, center: str = "_center") -> DataFrame:
    """df with the median and 1.4826 times the median deviation from it of the whole trace."""
    df = per_trace(df, **{center: median(column)})
    return per_trace(df, **{out: 1.4826 * median(F.abs(F.col(column) - F.col(center)))})
