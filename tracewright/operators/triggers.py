"""Short against long averages, triggers and their match with known times."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling, runs

#: Stretches that are matched in one call, each by itself: a call has a fixed cost.
STRETCHES = 1024


def ratio(df: DataFrame, column: str, out: str, short: int, long: int) -> DataFrame:
    """Root of the boxcar of squares over the boxcar of that root."""
    df = rolling.boxcar(df.withColumn("_square", F.col(column) * F.col(column)), "_square", short, "_env").withColumn("_env", F.sqrt("_env"))
    df = rolling.boxcar(df, "_env", long, "_bg")
    return df.withColumn(out, F.col("_env") / F.greatest("_bg", F.lit(1e-12))).drop("_square", "_env", "_bg")


def classic_ratio(df: DataFrame, column: str, out: str, short: int, long: int) -> DataFrame:
    """Trailing mean of squares over a longer one; 0 until the longer one is full."""
    df = df.withColumn("_square", F.col(column) * F.col(column))
    df = rolling.rolling_sum(df, "_square", short - 1, 0, "_sta")
    df = rolling.rolling_sum(df, "_square", long - 1, 0, "_lta")
    return df.withColumn(out, F.when(F.col("idx") < long - 1, 0.0).otherwise(F.col("_sta") / short / F.greatest(F.col("_lta") / long, F.lit(1e-12)))).drop("_square", "_sta", "_lta")


def hysteresis(df: DataFrame, column: str, on: float, off: float) -> DataFrame:
    """trace_id, s, e: from where the column rises above `on` to where it last is at least `off`.

    Runs above `off` are triggers if some sample of them is above `on`; they start at the first such one.
    """
    held = runs.runs(df.withColumn("_held", F.col(column) >= off), "_held").withColumnRenamed("s", "_from")
    from .ranges import samples_in

    fired = samples_in(df.where(F.col(column) > on).select("trace_id", "idx"), held, s="_from")
    return fired.groupBy("trace_id", "_from", "e").agg(F.min("idx").alias("s")).select("trace_id", "s", "e")


def intervals(df: DataFrame, column: str, on: float, gap: int, least: int) -> DataFrame:
    """Runs above `on`, joined over small gaps, of a least length."""
    return runs.merged(runs.runs(df.withColumn("_on", F.col(column) > on), "_on"), gap).where(runs.length() >= least)


def matched(triggers: DataFrame, centres: DataFrame, reach: int) -> DataFrame:
    """Centres (trace_id, c), in order, each with the first trigger whose middle is within reach and that no earlier centre took: s, e or null.

    Centres and triggers with more than `reach` between them can't meet, so each stretch without such a gap is matched by itself.
    """
    rows = centres.select("trace_id", F.col("c").cast("double").alias("at"), F.col("c").cast("long").alias("c"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"))
    rows = rows.unionByName(triggers.select("trace_id", ((F.col("s") + F.col("e")) / 2).alias("at"), F.lit(None).cast("long").alias("c"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")))
    line = Window.partitionBy("trace_id").orderBy("at")
    rows = rows.withColumn("new", (F.coalesce(F.col("at") - F.lag("at").over(line), F.lit(0.0)) > reach).cast("int"))
    rows = rows.withColumn("stretch", F.sum("new").over(line.rangeBetween(Window.unboundedPreceding, 0)))

    def sweep(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        held, place, out = defaultdict(list), defaultdict(int), []
        for x in points[points.c.isna()].sort_values("s").itertuples(index=False):
            held[x.stretch].append((x.at, int(x.s), int(x.e)))
        for x in points[points.c.notna()].sort_values("c").itertuples(index=False):
            mine, at = held[x.stretch], place[x.stretch]
            while at < len(mine) and mine[at][0] < x.at - reach:
                at += 1
            hit = at < len(mine) and mine[at][0] <= x.at + reach
            out.append((key[0], int(x.at), *(mine[at][1:] if hit else (None, None))))
            place[x.stretch] = at + hit
        return pd.DataFrame(out, columns=["trace_id", "c", "s", "e"]).astype({"c": "int64", "s": "Int64", "e": "Int64"})

    return rows.groupBy("trace_id", F.floor(F.col("stretch") / STRETCHES)).applyInPandas(sweep, "trace_id string, c long, s long, e long")


def rates(triggers: DataFrame, centres: DataFrame, reach: int) -> DataFrame:
    """By trace: the share of centres that were hit, the share of triggers that hit none, and the mean distance of hits."""
    found = matched(triggers, centres, reach)
    hits = found.groupBy("trace_id").agg(F.count("s").alias("hits"), F.count(F.lit(1)).alias("centres"), F.avg(F.abs((F.col("s") + F.col("e")) / 2 - F.col("c"))).alias("time_error"))
    rows = hits.join(triggers.groupBy("trace_id").agg(F.count(F.lit(1)).alias("triggers")), "trace_id", "left").withColumn("triggers", F.coalesce("triggers", F.lit(0)))
    return rows.select("trace_id", (F.col("hits") / F.col("centres")).alias("keep_rate"), F.try_divide(F.col("triggers") - F.col("hits"), F.col("triggers")).alias("false_rate"), "time_error")


def onsets(df: DataFrame, columns: list[str], thresholds: list[float], off: float, short: int, long: int) -> DataFrame:
    """trace_id, series, threshold, s, e: triggers of each column's ratio at each threshold, which end below `off` times it. Columns lose their trace's mean."""
    from .storage import settled

    rows = rolling.per_trace(df, **{f"_m{i}": F.avg(c) for i, c in enumerate(columns)})
    series = F.explode(F.array(*(F.struct(F.lit(c).alias("series"), (F.col(c) - F.col(f"_m{i}")).alias("x")) for i, c in enumerate(columns))))
    rows = rows.select("trace_id", "idx", series.alias("_x")).select(F.struct("trace_id", "_x.series").alias("trace_id"), "idx", "_x.x")
    cf = settled(classic_ratio(rows, "x", "r", short, long).select("trace_id", "idx", "r"), "ratios")
    many = cf.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    many = many.select(F.struct("trace_id.trace_id", "trace_id.series", "threshold").alias("trace_id"), "idx", (F.col("r") / F.col("threshold")).alias("q"))
    found = hysteresis(many, "q", 1.0, off)
    return found.select("trace_id.*", "s", "e")


def retention(found: DataFrame, windows: DataFrame, truth: str, series: list[str], thresholds: list[float]) -> DataFrame:
    """series, threshold, mean and retained_pct: triggers that start in a window (trace_id, s, e), averaged over windows, and that in percent of the truth's."""
    every = windows.select("trace_id", F.col("s").alias("w0"), F.col("e").alias("w1"))
    hits = _started(found, every)
    n = windows.groupBy().agg(F.count(F.lit(1)).alias("windows"))
    grid = n.withColumn("series", F.explode(F.array(*(F.lit(c) for c in series)))).withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    means = grid.join(hits, ["series", "threshold"], "left").select("series", "threshold", F.try_divide(F.coalesce("hits", F.lit(0)).cast("double"), F.col("windows")).alias("mean"))
    return means.join(means.where(F.col("series") == truth).select("threshold", F.col("mean").alias("_t")), "threshold", "left").select("series", "threshold", "mean", F.try_divide(100 * F.col("mean"), F.col("_t")).alias("retained_pct"))


def _started(found: DataFrame, windows: DataFrame) -> DataFrame:
    """series, threshold and hits: pairs of a trigger and a window that holds its start."""
    from .ranges import samples_in

    starts = found.select("trace_id", F.col("s").alias("idx"), "series", "threshold")
    return samples_in(starts, windows, s="w0", e="w1").groupBy("series", "threshold").agg(F.count(F.lit(1)).alias("hits"))
