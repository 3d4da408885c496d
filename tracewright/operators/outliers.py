"""Outliers by local density and by isolation, judged against the whole trace."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rolling import CHUNK
from .storage import settled


def value_ranks(df: DataFrame, column: str, out: str, buckets: int = 256, chunk: int = CHUNK) -> DataFrame:
    """Adds each row's place, from 0, among its trace's values in order of (value, idx); nulls come first.

    Ranges of values are windows of their own, and a value so frequent that it bounds a range has one per chunk of idx; totals of earlier ones are added.
    """
    v = F.col(column)
    bounds = df.groupBy("trace_id").agg(F.array_distinct(F.coalesce(F.percentile_approx(v, F.array(*(F.lit(i / buckets) for i in range(1, buckets)))), F.array().cast("array<double>"))).alias("_bounds"))
    rows = df.join(F.broadcast(bounds), "trace_id")
    held = F.col("_bounds")
    rows = rows.withColumn("_range", F.when(v.isNull(), -1).otherwise(F.size(F.filter(held, lambda b: b < v))))
    often = v.isNull() | F.array_contains(held, v)
    rows = rows.withColumns({"_often": F.coalesce(often, F.lit(True)), "_part": F.when(F.coalesce(often, F.lit(True)), F.floor(F.col("idx") / chunk)).otherwise(0)}).drop("_bounds")
    rows = settled(rows, "ranges")
    keys = ["_range", "_often", "_part"]
    earlier = Window.partitionBy("trace_id").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("trace_id", *keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = Window.partitionBy("trace_id", *keys).orderBy(column, "idx")
    return rows.join(before, ["trace_id", *keys]).withColumn(out, F.col("_before") + F.row_number().over(within) - 1).drop("_before", *keys)


def local_outlier_factor(df: DataFrame, column: str, k: int = 20, chunk: int = 3000, out: str = "lof") -> DataFrame:
    """The local outlier factor of each value among those of its trace.

    On one axis the k nearest of a value lie within k places of it in sorted order, so three looks at these suffice:
    distance to the k-th, density, and the neighbours' density over one's own. Equal densities give 1.
    Groups are chunks of a trace's sorted values; rows within 3k places of a chunk, k a look, go there too.
    """
    rows = value_ranks(df, column, "_rank")
    reach = lambda by: F.greatest(F.lit(0), F.floor((F.col("_rank") + by) / chunk))
    rows = rows.select(*df.columns, "_rank", F.col(column).cast("double").alias("_v"), F.explode(F.sequence(reach(-3 * k), reach(3 * k))).alias("_chunk"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema if f.name != out), T.StructField(out, T.DoubleType())])

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rank")
        own = table["_rank"].to_numpy() // chunk == table["_chunk"].to_numpy()
        held = table["_v"].combine_chunks()
        lof = density_ratio(held.to_numpy(zero_copy_only=False), held.is_null().to_numpy(zero_copy_only=False), table["idx"].to_numpy(), k)
        return table.select([n for n in schema.names if n != out]).append_column(out, pa.array(lof)).filter(pa.array(own))

    return rows.groupBy("trace_id", "_chunk").applyInArrow(each, schema)


def density_ratio(v: np.ndarray, none: np.ndarray, idx: np.ndarray, k: int) -> np.ndarray:
    """Local outlier factors of values in order of size. Of equal distances that to the lesser idx is nearer; the distance to a value that is null is less than any and counts as 0."""
    near = np.arange(len(v))[:, None] + np.concatenate([np.arange(-k, 0), np.arange(1, k + 1)])
    inside = (near >= 0) & (near < len(v))
    near = near.clip(0, len(v) - 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.where(none[near] | none[:, None], -1.0, np.abs(v[near] - v[:, None]))
        order = np.lexsort((np.where(inside, idx[near], np.iinfo(np.int64).max), np.where(inside, d, np.nan)))[:, :k]
        near, d, n = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1), inside.sum(1).clip(max=k)
        there = np.arange(order.shape[1]) < n[:, None]
        mean = lambda x: np.cumsum(np.where(there, x, 0.0), 1)[:, -1] / n.clip(1)
        far = np.where(n > 0, d[np.arange(len(v)), n - 1], 0.0)
        far = np.where(far < 0, 0.0, far)
        density = 1 / np.maximum(mean(np.maximum(far[near], d)), 1e-10)
        return np.where(n == 0, 1.0, mean(density[near]) / density)


def isolation(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> np.ndarray:
    """Scores from 0 to 1: how few random cuts set a value apart, averaged over trees on random samples."""
    rng, size = np.random.default_rng(seed), min(sample, len(x))
    usual = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    depth, most = np.zeros(len(x)), int(np.ceil(np.log2(max(size, 2))))
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    for _ in range(trees):
        held = np.sort(rng.choice(x, size, replace=False))
        stack = [(0, size, 0, 0, len(x))]  # of the sample and of all values: what falls into a node
        while stack:
            a, b, level, p, q = stack.pop()
            if level >= most or b - a <= 1 or held[b - 1] == held[a]:
                depth[order[p:q]] += level + usual(b - a)
                continue
            cut = rng.uniform(held[a], held[b - 1])
            m, s = int(np.searchsorted(held[a:b], cut, "right")) + a, int(np.searchsorted(ranked[p:q], cut, "right")) + p
            stack += [(a, m, level + 1, p, s), (m, b, level + 1, s, q)]
    return 2.0 ** (-(depth / trees) / max(usual(size), 1e-12))


def isolated(df: DataFrame, column: str, contamination: float = 0.01, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """trace_id, idx, score and isolated: each trace's highest scores, of the stated share. Trees are grown per chunk."""
    rows = df.select("trace_id", "idx", F.col(column).cast("double").alias("v"), F.floor(F.col("idx") / chunk).alias("_chunk")).where(F.col("v").isNotNull() & ~F.isnan("v"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"trace_id": pdf["trace_id"], "idx": pdf["idx"], "score": isolation(pdf["v"].to_numpy(), seed=seed)})

    scores = settled(rows.groupBy("trace_id", "_chunk").applyInPandas(each, "trace_id string, idx long, score double"), "isolation")
    cuts = scores.groupBy("trace_id").agg(F.percentile("score", F.lit(1 - contamination)).alias("_cut"))
    return scores.join(F.broadcast(cuts), "trace_id").withColumn("isolated", F.col("score") > F.col("_cut")).drop("_cut")
