"""Numbering of rows within a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str = "idx") -> DataFrame:
    """Numbers rows from 0 by (bucket, *order) within keys. bucket must grow with the order: each one is numbered by itself and moved on by the counts before it."""
    rows = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*by).orderBy(*order)
    return rows.join(offsets, by).withColumn(out, (F.col("_offset") + F.row_number().over(within) - 1).cast("long")).drop("_bucket", "_offset")
