"""Repairs in an order: each one sees what earlier ones made, and later ones' segments stand at their level while it looks around.

Tasks are segments with a round; within a round they go from left to right. Two tasks depend on each other only if they are near, so those of a trace fall into islands, and all islands go
forward together by chunks of rolling.CHUNK places: a chunk of an island is a group, which holds its samples and those within reach and goes through its tasks in order. Chunks that have the
same place in their islands are one Spark job, which sees what the jobs before it have written. There are as many jobs as the longest island has chunks, however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edges import Chunk
from ..operators import ranges, rolling
from ..operators.storage import fresh_path, settled
from .replace import CONTEXT

KEY = ["trace_id", "s", "e"]
GROUP = ["trace_id", "round", "island", "job"]
VALUES = "trace_id string, s long, e long, idx long, w double, step int"
MADE = f"{VALUES}, method string, verdict string"
COLUMNS = ["trace_id", "s", "e", "idx", "w", "step", "method", "verdict"]

#: From a task's s and e and the arrays before, after, left and right: its values, nan where there are none.
Rebuild = Callable[..., np.ndarray]
#: From a task's s and e, its new values and the samples around it: the values to keep (None: keep none), and a verdict.
Finish = Callable[[int, int, np.ndarray, Chunk], tuple[np.ndarray | None, str]]


def leveled(tasks: DataFrame, reach: int) -> DataFrame:
    """Tasks (trace_id, s, e, round) with their `island`, and `level`: how many tasks of the round lie before it in its island. Islands lie more than `reach` apart."""
    order = Window.partitionBy("trace_id", "round").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = tasks.withColumn("_new", (before.isNull() | (F.col("s") - before > reach)).cast("int"))
    rows = rows.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return rows.withColumn("level", (F.row_number().over(Window.partitionBy("trace_id", "round", "island").orderBy("s", "e")) - 1).cast("int"))


def at_reference_level(s: int, e: int, before: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The median of both references in every place: the plainest rebuilding. Without references there are no values."""
    both = np.concatenate([before, after])
    return np.full(e - s + 1, np.median(both) if len(both) else np.nan)


def _spans(todo: DataFrame, reach: int) -> DataFrame:
    return todo.groupBy(*GROUP).agg(F.greatest(F.min("s") - reach, F.lit(0)).alias("_w0"), (F.max("e") + reach).alias("_w1"))


def _groups(todo: DataFrame, events: DataFrame, reach: int) -> DataFrame:
    """By GROUP: its own tasks (those with a step), and the segments within reach of them, events without a round."""
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / rolling.CHUNK), F.floor(b / rolling.CHUNK)))
    segments = todo.select(*KEY, F.col("round").alias("of")).unionByName(events.select(*KEY, F.lit(None).cast(todo.schema["round"].dataType).alias("of")))
    right = segments.withColumn("_b", spread(F.col("s"), F.col("e")))
    met = _spans(todo, reach).withColumn("_b", spread(F.col("_w0"), F.col("_w1"))).join(right, ["trace_id", "_b"]).where("s <= _w1 AND e >= _w0").select(*GROUP, "s", "e", "of").distinct()
    own = todo.select(*GROUP, "s", "e", F.col("round").alias("of"), "step", "method", "n", "whole")
    return own.unionByName(met, allowMissingColumns=True)


def _in_order(rebuild: Rebuild, finish: Finish | None, sr: float, gap: int, reach: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a group makes of its samples and segments, one task after the other."""

    def run(near: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
        mine, others = segments[segments.step.notna()].sort_values(["s", "e"]), segments[segments.step.isna()]
        if not len(near) or not len(mine):
            return pd.DataFrame(columns=COLUMNS)
        lo, size = int(near.idx.min()), int(near.idx.max() - near.idx.min()) + 1

        def laid(column: str, empty) -> np.ndarray:
            out = np.full(size, empty)
            out[(near.idx - lo).to_numpy()] = near[column].to_numpy()
            return out

        chunk = Chunk(lo, int(mine.n.iloc[0]), laid("v", np.nan), laid("bad", True), *((laid("first", np.nan), laid("first_bad", True)) if finish else ()))
        starts, ends, of = others.s.to_numpy(), others.e.to_numpy(), others.of.to_numpy(float)
        trace, values, verdicts = near.trace_id.iloc[0], [], []
        for task in mine.itertuples(index=False):
            s, e, step = int(task.s), int(task.e), int(task.step)
            later = np.isnan(of) | (of > task.of) | ((of == task.of) & ((starts > s) | ((starts == s) & (ends > e))))
            close = np.flatnonzero(later & (starts <= e + reach) & (ends >= s - reach))
            parts = [(int(starts[i]), int(ends[i])) for i in close]
            length = int(np.rint(min(max((e - s + 1) / sr * 0.5, 120.0), 600.0) * sr))  # as ranges.auto_reference
            windows = [(max(0, s - gap - length), s - gap - 1), (e + 1 + gap, min(chunk.n - 1, e + gap + length)), (s - CONTEXT, s - 1), (e + 1, e + CONTEXT)]
            w, at = np.asarray(rebuild(s, e, *chunk.seen(s, e, parts, reach, task.whole, windows)), float), chunk.cut(s, e)
            if finish:
                w, verdict = finish(s, e, np.where(np.isnan(w), chunk.v[at], w), chunk)
                verdicts.append((trace, s, e, None, None, step, task.method, verdict))
            if w is not None and (new := np.flatnonzero(~np.isnan(w))).size:
                chunk.v[at.start + new], chunk.bad[at.start + new] = w[new], False
                values.append(pd.DataFrame({"trace_id": trace, "s": s, "e": e, "idx": s + new, "w": w[new], "step": step, "method": None, "verdict": None}))
        listed = [pd.DataFrame(verdicts, columns=COLUMNS).astype({"idx": "Int64"})] if verdicts else []
        return pd.concat([*values, *listed]) if values or listed else pd.DataFrame(columns=COLUMNS)

    return run


def in_rounds(samples: DataFrame, tasks: DataFrame, events: DataFrame, rebuild: Rebuild, sr: float, gap_s: float = 1.0, most_s: float = 600.0, finish: Finish | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Repairs tasks (trace_id, s, e, round, ...) of samples (trace_id, idx, v, bad, and first and first_bad for a `finish`): their new values (VALUES), and the verdicts if there is a `finish`.

    References reach most_s at most. Where several tasks give a sample a value, the last one's holds. step: a task's place in its island, counted on from round to round.
    """
    spark = samples.sparkSession
    gap, reach = round(gap_s * sr), int(most_s * sr) + round(gap_s * sr)
    flags, numbers = (["bad", "first_bad"], ["v", "first"]) if finish else (["bad"], ["v"])
    held = samples.select("trace_id", "idx", *(F.col(c).cast("double").alias(c) for c in numbers), *(F.coalesce(c, F.lit(True)).alias(c) for c in flags))
    whole = samples.groupBy("trace_id").agg((F.max("idx") + 1).alias("n"), rolling.median(F.when(~F.col("bad"), F.col("v").cast("double"))).alias("whole"))
    job = F.dense_rank().over(Window.partitionBy("trace_id", "round", "island").orderBy(F.floor(F.col("s") / rolling.CHUNK))) - 1
    todo = leveled(tasks, 2 * reach).join(whole, "trace_id").withColumns({"job": job, "method": F.col("method") if "method" in tasks.columns else F.lit(None).cast("string")})
    todo = settled(todo.select(*GROUP, "s", "e", "level", "method", "n", "whole"), "tasks")
    sizes = todo.groupBy("round").agg(F.max("job").alias("job"), F.max("level").alias("level")).orderBy("round").collect()  # a row for each round
    if not sizes:
        return spark.createDataFrame([], VALUES), None
    first = F.lit(0)
    for size in reversed(sizes):
        first = F.when(F.col("round") > size["round"], size["level"] + 1).otherwise(0) + first
    groups = settled(_groups(todo.withColumn("step", (F.col("level") + first).cast("int")), events, reach), "groups")
    spans, base, run = _spans(todo, 2 * reach), fresh_path(spark, "rounds"), _in_order(rebuild, finish, sr, gap, reach)
    made = lambda path: spark.read.schema(MADE).parquet(path).where("idx IS NOT NULL").select("trace_id", "s", "e", "idx", "w", "step")

    def with_made(rows: DataFrame, values: DataFrame) -> DataFrame:
        last = values.groupBy("trace_id", "idx").agg(F.max_by("w", "step").alias("_w"))
        return rows.join(last, ["trace_id", "idx"], "left").withColumns({"v": F.coalesce("_w", "v"), "bad": F.col("bad") & F.col("_w").isNull()}).drop("_w")

    for k, size in enumerate(sizes):
        held = settled(with_made(held, made(base)), "held") if k else held
        mine, path = settled(spans.where(F.col("round") == size["round"]), "spans"), fresh_path(spark, "near")
        rows = ranges.samples_in(held, mine, s="_w0", e="_w1").drop("_w0", "_w1")
        rows.repartition("job", "trace_id", "island").write.partitionBy("job").parquet(path)
        for j in range(size["job"] + 1):
            near = spark.read.schema(rows.schema).parquet(path).where(F.col("job") == j)
            if j:
                near = with_made(near, ranges.samples_in(made(f"{base}/round={size['round']}"), mine.where(F.col("job") == j).select("trace_id", "_w0", "_w1"), "left_semi", s="_w0", e="_w1"))
            own = groups.where((F.col("round") == size["round"]) & (F.col("job") == j))
            near = near.repartition(4 * spark.sparkContext.defaultParallelism, *GROUP)
            near.groupBy(*GROUP).cogroup(own.groupBy(*GROUP)).applyInPandas(run, MADE).write.parquet(f"{base}/round={size['round']}/job={j}")
    verdicts = spark.read.schema(MADE).parquet(base).where("idx IS NULL").select(*KEY, "method", "verdict")
    return made(base), verdicts if finish else None


def applied(samples: DataFrame, values: DataFrame) -> DataFrame:
    """Samples with w: the last value that a repair gave them, else v."""
    last = values.groupBy("trace_id", "idx").agg(F.max_by("w", "step").alias("_w"))
    return samples.join(last, ["trace_id", "idx"], "left").withColumn("w", F.coalesce("_w", F.col("v").cast("double"))).drop("_w")
