"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders by application, for local sessions that name no shared one.
_OWN: dict[str, str] = {}
#: What each application has written, until cleanup().
_WRITTEN: dict[str, list[str]] = defaultdict(list)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); only a local session may do without and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="tracewright-")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path there that nothing has, to be deleted by cleanup()."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[spark.sparkContext.applicationId].append(path)
    return path


def settled(df: DataFrame, name: str = "rows") -> DataFrame:
    """The same rows, written once and read back: what is built on them several times isn't computed several times, nor after a lost executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; for when its results are stored."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
