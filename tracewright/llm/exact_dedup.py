"""Exact de-duplication against a persistent digest index.

The index is a table with one row per digest, bucketed and sorted by the digest. New data is reduced to one row per
digest, anti-joined with the index by sort-merge (bucket by bucket, without a shuffle of the index) and appended.
Texts are equal when they are identical after each run of white space is replaced by one space.

Cases: a null text counts as empty; of equal texts the row with the smallest id stays (rows whose id is null come
last, and of repeated rows with that id all are marked kept, as nothing tells them apart); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh_path, spread_join, written

SPACES = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as lowercase hex."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ").cast("binary"), 256)


#: Digests that a bucket is made for.
BUCKET_DIGESTS = 2_000_000


class DigestIndex:
    """Rows (digest, keep_id, batch) in buckets by the digest, each file sorted by it.

    The files at `path` are the index: whoever names the same path, in this session or a later one, opens the same index. The number of buckets
    is set when the index is made, from the digests that it is expected to hold, and kept beside the files. `name` is only the
    session's name for it.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, expected: int = 32 * BUCKET_DIGESTS, buckets: int | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "digest-index")
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        about = f"{self.path}/_about"  # a folder that readers of the table pass over
        if self._there(about):
            self.buckets = spark.read.schema("buckets int").json(about).first()[0]
        else:
            self.buckets = buckets or max(32, 1 << math.ceil(math.log2(max(1, expected / BUCKET_DIGESTS))))
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.json(about)
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def forget(self) -> None:
        """Takes the index's name out of the session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """The rows of (digest, ...) whose digest the index doesn't have: a sort-merge anti-join."""
        return digests.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame, batch: str) -> None:
        """Adds one row per digest of (digest, keep_id) that isn't there yet."""
        new = self.unseen(digests).select("digest", F.col("keep_id").cast("long").alias("keep_id"), F.lit(batch).alias("batch"))
        new = written(new, "digests-new")  # the table that is read can't be written at the same time
        new.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).mode("append").saveAsTable(self.name)


def deduplicate(df: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """Takes df into the index and returns a row for each of its rows: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the row that the index holds for the text, which an earlier batch may have brought; group_size counts
    the equal texts of df; kept marks the row that the index now holds. batch: a name that no earlier batch had (made up if not given).
    """
    batch = batch or uuid.uuid4().hex
    rows = written(df.select(col(key).cast("long").alias("doc_id"), digest(col(text)).alias("digest")), "digests")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "digest-groups")
    index.append(groups.select("digest", "keep_id"), batch)
    held = index.table().select("digest", "keep_id", "batch")
    groups = written(groups.drop("keep_id").join(held, "digest"), "digest-held")
    kept = (F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return spread_join(rows, groups, "digest", "group_size").select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))
