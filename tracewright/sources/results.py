"""Results of many cases as a partitioned table: one that fails is a row without values, and a run that is started again skips what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import settled

PARTITIONS = ("event", "anom_type", "level")


def case_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a case's parameters by name, nulls told from texts."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"}).cast("binary"), 256)


class ResultStore:
    """Rows (digest, the case's columns, status, error, metrics...) by event, anomaly and level."""

    def __init__(self, spark: SparkSession, path: str, metrics: Sequence[str]):
        self.spark, self.path, self.metrics = spark, path, tuple(metrics)

    def _there(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path)

    def run(self, cases: DataFrame, measure: Callable[[dict], dict], retry_failed: bool = False) -> None:
        """Measures the cases that have no row yet (or a failed one, if those are to be tried again) and appends their rows.

        measure gets a case's columns and returns its metrics. What it raises is the row's `error`, its metrics are null, and the other cases go on.
        """
        names, metrics = cases.columns, self.metrics
        rows = cases.withColumn("digest", case_digest(names))
        if self._there():
            done = self.read().groupBy("digest").agg(F.max((F.col("status") == "ok").cast("int")).alias("ok"))
            rows = rows.join(done if not retry_failed else done.where("ok = 1"), "digest", "left_anti")
        rows = rows.dropDuplicates(["digest"])

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for case in frame.to_dict("records"):
                    try:
                        found = measure({c: case[c] for c in names})
                        out.append({"digest": case["digest"], "status": "ok", "error": None} | {m: None if found.get(m) is None else float(found[m]) for m in metrics})
                    except Exception as problem:  # noqa: BLE001 - one case's failure is its result
                        out.append({"digest": case["digest"], "status": "failed", "error": f"{type(problem).__name__}: {problem}"[:500]} | dict.fromkeys(metrics))
                yield pd.DataFrame(out, columns=["digest", "status", "error", *metrics]).astype({m: "float64" for m in metrics})

        rows = settled(rows, "cases")
        measured = rows.mapInPandas(each, "digest string, status string, error string, " + ", ".join(f"`{m}` double" for m in metrics))
        for m in metrics:  # pandas has no null of its own in columns of numbers
            measured = measured.withColumn(m, F.when(F.col("status") == "ok", F.nanvl(F.col(m), F.lit(None))))
        by = [c for c in PARTITIONS if c in names]
        rows.join(measured, "digest").repartition(*by).write.partitionBy(*by).mode("append").parquet(self.path)

    def summary(self, by: Sequence[str]) -> DataFrame:
        """Per group: cases, failed ones, and each metric's mean over the others; of a case that was tried again, the row that succeeded counts."""
        best = self.read().withColumn("_ok", (F.col("status") == "ok").cast("int"))
        one = best.groupBy("digest").agg(F.max_by(F.struct(*(c for c in best.columns if c not in ("_ok", "digest"))), "_ok").alias("r")).select("r.*")
        return one.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("status") == "failed").alias("failed"), *(F.avg(m).alias(m) for m in self.metrics))

    def provenance(self, **about: str) -> DataFrame:
        """One row: rows, failed ones, a digest over all cases that doesn't depend on their order, and what the caller adds."""
        crc = F.crc32(F.concat_ws("|", "digest", "status").cast("binary"))
        out = self.read().agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(crc).alias("checksum"))
        return out.select("*", *(F.lit(v).alias(k) for k, v in about.items()))
