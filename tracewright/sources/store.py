"""Stored tables of which only what changed is written again: samples by trace and block, catalogs by station and day.

Both are Parquet folders partitioned by what a change touches. A change reads the touched partitions only (they are pruned by their names), settles
the new rows, and replaces those partitions in one commit; all other files stay as they are, names included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranges
from ..operators.storage import settled
from . import catalogs

#: Samples of a block: of the order of a hundred megabytes as Parquet.
BLOCK = 1 << 24
#: Partitions that a filter names one by one; beyond so many they are joined.
MOST_NAMED = 1_000
#: The setting for how many tasks list the folders of a table at most.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


class _Partitioned:
    """A folder partitioned by `keys`, which have these types whatever their values look like."""

    keys: dict[str, T.DataType] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.schema = spark, path, None

    def _put(self, rows: DataFrame, overwrite: bool) -> None:
        if self.schema is not None and set(rows.columns) != set(self.schema.names):
            self.schema = None
        writer = rows.repartition(*self.keys).write.partitionBy(*self.keys)
        (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if overwrite else writer.mode("append")).parquet(self.path)

    def read(self) -> DataFrame:
        """The stored table. Folders are listed by as many tasks as there are cores, not by one for each; the schema is looked for once."""
        before = self.spark.conf.get(LISTING)
        self.spark.conf.set(LISTING, str(min(int(before), self.spark.sparkContext.defaultParallelism)))
        try:
            if self.schema is None:
                found = self.spark.read.parquet(self.path).schema
                self.schema = T.StructType([T.StructField(f.name, self.keys.get(f.name, f.dataType)) for f in found])
            return self.spark.read.schema(self.schema).parquet(self.path)
        finally:
            self.spark.conf.set(LISTING, before)

    def touched(self, keys: DataFrame) -> DataFrame:
        """The rows of the partitions that keys name."""
        named = keys.select(*self.keys).distinct().limit(MOST_NAMED + 1).collect()
        table = self.read()
        if len(named) > MOST_NAMED:
            return table.join(keys.select(*self.keys).distinct(), list(self.keys), "left_semi")
        either = [reduce(lambda a, b: a & b, (F.col(k) == F.lit(row[k]) for k in self.keys)) for row in named]
        return table.where(reduce(lambda a, b: a | b, either, F.lit(False)))


class SampleStore(_Partitioned):
    """Samples (trace_id, idx, ...) by trace and block of `block` places."""

    keys = {"trace_id": T.StringType(), "block": T.LongType()}

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        super().__init__(spark, path)
        self.block = block

    def _of(self, idx: Column) -> Column:
        return F.floor(idx / self.block)

    def append(self, samples: DataFrame) -> None:
        self._put(samples.withColumn("block", self._of(F.col("idx"))), False)

    def write_back(self, values: DataFrame, within: DataFrame, column: str = "v") -> None:
        """Puts values (trace_id, idx, w) in the place of `column`, where a range of `within` (trace_id, s, e) holds the sample. The blocks that ranges touch are written again."""
        held = settled(within.select("trace_id", "s", "e"), "ranges")
        blocks = held.select("trace_id", F.explode(F.sequence(self._of(F.col("s")), self._of(F.col("e")))).alias("block")).distinct()
        old = self.touched(settled(blocks, "blocks"))
        new = ranges.samples_in(values.select("trace_id", "idx", "w"), held, "left_semi").select("trace_id", "idx", F.col("w").alias("_w"))
        rows = old.join(new, ["trace_id", "idx"], "left").withColumn(column, F.coalesce(F.col("_w").cast(old.schema[column].dataType), F.col(column)))
        self._put(settled(rows.select(*old.columns), "blocks-new"), True)

    def samples(self) -> DataFrame:
        return self.read().drop("block")


class CatalogStore(_Partitioned):
    """Catalog rows (station, day, s, e, kind, method, note, ...) by station and day."""

    keys = {"station": T.StringType(), "day": T.StringType()}

    def append(self, rows: DataFrame) -> None:
        self._put(rows, False)

    def replace_days(self, rows: DataFrame, manual: DataFrame | None = None) -> None:
        """Replaces all rows of the days in rows. Repairs that overlap a manual range (station, day, s, e) are marked as made by hand."""
        self._put(settled(rows if manual is None else catalogs.marked_manual(rows, manual), "days-new"), True)
